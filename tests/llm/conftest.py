from llm_rows import none, odd  # noqa: F401
