"""Registered queries and the SQL they are checked against."""

import importlib

for _name in ("communication", "case_timeline", "flows", "scoping", "networks", "texts", "oversight", "chains", "normal_forms", "case_graph", "scores", "social", "records", "document_reading", "review"):
    importlib.import_module(f"evidentia.plans.{_name}")
