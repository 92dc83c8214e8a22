"""Texts that operators tend to trip over."""

HARD_TEXTS = [
    None, "", " ", "\n", " a", "a ", "a  b", "a   b", "\n\nfoo", "a\n b\n\n c", "it's DON'T 'S we'll,", "<|endoftext|> x<|startoftext|>",
    "é ́x ẞ İ ΣΣ Σ", "a b c​d", "ﬁ １2３ ½ Ⅷ", "\U0001f600!!\U0001f600 \U0001f469‍\U0001f469", "tab\tand\r\nfeed\x0b\x0c\x1c\x85", "word,,!! (word) word.word",
    "中文字 あい", "x" * 5000, "ab " * 4000, "\x00\x01", "a@b.c 1.2.3.4",
]
