"""Rows with nulls, empty and long texts, ties, repeated rows and clashing column names."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, idx int, _rk string"

FIRST = "the quick brown fox jumps over the lazy dog while the old man reads a long letter from his sister in the town"
OTHER = "der alte mann liest einen langen brief von seiner schwester und trinkt dabei eine tasse kaffee in der kueche"


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, None if text is None else len(text), 0.5, 7, "mine")


def edge_rows():
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30000))
    near = FIRST + " " + " ".join(f"tail{i}" for i in range(60))
    return [
        row(0, None), row(1, ""), row(2, "   \t\n "), row(3, FIRST), row(4, FIRST), row(4, FIRST),
        row(5, near), row(6, near + " one more"), row(7, OTHER, "de"), row(8, OTHER + " " + FIRST, None, None),
        row(9, long), row(10, "a"), row(11, "123 ?! 456", None), row(12, "\x00\x01 nul bytes \x00"),
        row(13, "日本語のテキスト と é̂ ñ 😀", "fr", "s1"), row(None, "a text without an id " * 8, "en", None),
        row(14, "ab" * 400), row(15, "x" * 3000), row(16, "A QUICK Brown fox"), row(17, "a quick brown fox"),
    ]
