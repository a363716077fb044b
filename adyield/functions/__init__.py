"""Column expressions shared by the operators: guarded ratios, clipping, calendar parts,
pandas-compatible casts, deterministic rounding (``exprs``) and summary/prompt text (``text``)."""
