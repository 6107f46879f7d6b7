"""Rows that every operator must take: null, empty, blank, punctuation only, one word, one word repeated, a long word, no id, a repeated id, no source."""

ODD = [(101, None), (102, ""), (103, " \n\t "), (104, "... !!"), (105, "word"), (106, "w " * 3000), (107, "x" * 20000), (None, "no id here at all"), (108, "twice"), (108, "twice"), (109, None, None), (110, "Ünïcode 日本語 \U0001f600", None)]
