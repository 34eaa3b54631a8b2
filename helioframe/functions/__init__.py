"""Column expressions: no shuffle, no state, all inside code generation."""
