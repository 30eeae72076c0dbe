"""Column expressions: identity, e-mail, page text, scores, decision ladders."""
