from test_operators import brute_components, documents, shingle_sets, similar, tokenizer  # noqa: F401
