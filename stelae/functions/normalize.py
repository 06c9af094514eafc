"""Text normalization and word matching.

White space runs become one space and the ends are trimmed; every other control
character is deleted without separating.  Case is kept and nothing is composed.
Java's ``\\s`` knows ASCII only, so both classes are spelled out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Controls that are no white space, and white space.
CONTROLS = r"[\x{0}-\x{8}\x{E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}]"
SPACES = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: What a text that is not in normal form has somewhere.
_UNUSUAL = (
    r"[\x{0}-\x{1F}\x{7F}-\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|  |^ | \z"
)


def normalized(text: Column) -> Column:
    """Normal form of a text; null stays null.  Most texts are in normal form, which
    one search finds; only the others are rewritten."""
    rewritten = F.trim(F.regexp_replace(F.regexp_replace(text, CONTROLS, ""), SPACES, " "))
    return F.when(text.rlike(_UNUSUAL), rewritten).otherwise(text)


def normalized_sql(text: str) -> str:
    """The same in DuckDB SQL."""
    return f"trim(regexp_replace(regexp_replace({text}, '{CONTROLS}', '', 'g'), '{SPACES}', ' ', 'g'), ' ')"


def _python(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u%04x" % int(m[1], 16), pattern))


_CONTROLS, _SPACES = _python(CONTROLS), _python(SPACES)


def normalized_text(text: str) -> str:
    """Normal form of one Python string, for arguments."""
    return _SPACES.sub(" ", _CONTROLS.sub("", text)).strip(" ")


def words_of(query: str) -> list[str]:
    """The words a query asks for."""
    return [w for w in normalized_text(query).split(" ") if w]


def has_all_words(text: Column, words: list[str]) -> Column:
    """Every word is a substring of ``text``, case counting; true for no words."""
    found = F.lit(True)
    for word in words:
        found = found & text.contains(word)
    return found
