"""Rows that every operator over documents must take."""

#: Nulls, empty and white texts, ties, repeated rows.
ODD = [
    (None, "word one two"), (1, None), (2, ""), (3, " \n\t "), (4, "solo"), (5, "same text here"), (6, "same text here"),
    (6, "same text here"), (7, "Apache License; MIT license. gnu GENERAL public-license cc-by cc by"),
    (8, "mail a@b.c_x@d.e, 10.0.0.1.2.3.4.5 card 4111 1111-1111 1111 call +1 (234) 567-8901 999.1.1.1"),
    (9, "x" * 5000 + " " + "1" * 3000 + " " + "a.b" * 2000 + " 1.2.3" * 500),
    (10, "é漢字 😀 ﷐ <|endoftext|> it's  two   spaces \n \n b"),
]
