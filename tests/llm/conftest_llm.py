def same_rest(got, odd):
    """Whether got has odd's columns, and in each of its rows all but text and n_chars are as they came."""
    rest = [c for c in odd.columns if c not in ("text", "n_chars")]
    rows = lambda df: [tuple(r) for r in df.select(*(f"`{c}`" for c in rest)).collect()]
    return got.columns == odd.columns and set(rows(got)) <= set(rows(odd))
