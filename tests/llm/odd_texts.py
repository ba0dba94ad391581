#: Texts that every operator must take: null, empty, blank, one word, no ASCII, one long word, repeats, much text, many short lines, more than a megabyte.
ODD = [
    None, "", " \n\t ", "word", "é ß 漢字 😀", "x" * 5000, "the same words " * 400, "a b c d e\n" * 300, "One two three. " * 2 + "\x00\x01▁ end", "  double  spaces  ",
    "The quick brown fox jumps over the lazy dog and runs on to the far green hills beyond the river today.",
    "The quick brown fox jumps over the lazy dog and runs on to the far green hills beyond the river today.",
]
ODD.append("".join(f"w{i * i % 9973}" + (".\n" if i % 170 == 0 else ". " if i % 17 == 0 else " ") for i in range(180_000)))
