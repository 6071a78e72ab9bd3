"""Column expressions and window builders."""
