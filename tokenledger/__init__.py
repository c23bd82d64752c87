"""Usage and cost analytics for LLM coding agents, as PySpark DataFrame operators."""
