"""The registered queries of this subpackage, each over whole tables, and their SQL where there is one."""

from __future__ import annotations

from .common import table
from .knn_join import op3_exact_top_k, op3_sql
from .language import op1_language
from .licenses import op6_licenses
from .neardup import op10_near_duplicates
from .nndescent import op9_nearest
from .packing import op2_packing
from .pieces import op8_pieces
from .secrets import op4_secrets, op4_sql
from .sharding import op5_sharding
from .toxicity import op7_toxicity

QUERIES = {
    "op1_language": lambda spark, d: op1_language(spark, table(spark, d, "documents")),
    "op2_packing": lambda spark, d: op2_packing(table(spark, d, "documents")),
    "op3_exact_top_k": lambda spark, d: op3_exact_top_k(table(spark, d, "embeddings")),
    "op4_secrets": lambda spark, d: op4_secrets(table(spark, d, "documents")),
    "op5_sharding": lambda spark, d: op5_sharding(table(spark, d, "documents")),
    "op6_licenses": lambda spark, d: op6_licenses(spark, table(spark, d, "documents")),
    "op7_toxicity": lambda spark, d: op7_toxicity(spark, table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_pieces": lambda spark, d: op8_pieces(spark, table(spark, d, "documents")),
    "op9_nearest": lambda spark, d: op9_nearest(table(spark, d, "embeddings")),
    "op10_near_duplicates": lambda spark, d: op10_near_duplicates(table(spark, d, "documents")),
}
ORACLE_SQL = {"op3_exact_top_k": op3_sql(), "op4_secrets": op4_sql()}
