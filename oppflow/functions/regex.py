"""Regular-expression pieces shared by the column functions.

Word boundaries are ASCII on purpose: a letter such as ``ł`` ends a word, so that
a place or technology name is never found inside a longer foreign word.
"""

WORD = "[A-Za-z0-9_]"
BOUND = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def literal(text: str) -> str:
    """``text`` with every character that has a meaning in a pattern escaped."""
    return "".join("\\" + c if c in r".*+?^${}()|[]\/" else c for c in text)


def word(pattern: str) -> str:
    """A pattern that begins and ends in a word character, as a whole word."""
    return f"(?<!{WORD}){pattern}(?!{WORD})"


def words(alternatives, tail: str = "", symbols: bool = False) -> str:
    """A case-insensitive whole-word pattern over ready-made alternatives.

    Terms that begin and end in a letter or digit only need a look at the character
    before and after; ``symbols`` is for lists with terms such as ``C++``.
    """
    before, after = (BOUND, BOUND) if symbols else (f"(?<!{WORD})", f"(?!{WORD})")
    return f"(?i){before}(?:{'|'.join(alternatives)}){tail}{after}"
