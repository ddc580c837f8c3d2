"""Reading of narrative documents: language, sentences, fields, identifiers, people, relations."""
