"""The modules of this subpackage that hold QUERIES and ORACLE."""

MODULES = ["quern.llm.conversations", "quern.llm.garbled", "quern.llm.personal", "quern.llm.tokens", "quern.llm.packing", "quern.llm.boilerplate", "quern.llm.subjects"]
