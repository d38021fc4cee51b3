"""Whether a chunk boundary falls where a sentence, a line of dialogue or a paragraph ends (F-BND)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import BLANK

# The patterns that define a good boundary. The dash range in _NEUTRAL runs from } to the em dash.
_NEUTRAL = f"[{BLANK}" + "\"'„”«»()\\[\\]{}-—]+"
_CLOSERS = "[\"'»”’)\\]}]*"
_SENTENCE_END = f"[.!?…]{_CLOSERS}[{BLANK}]*$"
_DIALOGUE_END = f"[:;,.?!][{BLANK}]*[-—]{_CLOSERS}[{BLANK}]*$"
_OPENS = f"^[{BLANK}" + "\"'„”«»(\\[]*[A-ZĄĆĘŁŃÓŚŹŻ]"


def good_boundary(before: Column, between: Column, after: Column) -> Column:
    """True where the text between two chunks is neutral and one of the accepted patterns holds."""
    gap = F.coalesce(between, F.lit(""))
    filled = (F.length(F.coalesce(before, F.lit(""))) > 0) & (F.length(F.coalesce(after, F.lit(""))) > 0)
    neutral = F.regexp_replace(gap, _NEUTRAL, "") == ""
    opens = after.rlike(_OPENS)
    first = F.substring(after, 1, 1)
    good = (
        ((before.rlike(_SENTENCE_END) | before.rlike(_DIALOGUE_END)) & opens)
        | gap.contains("\n\n")
        | (before.endswith("!") & (gap == " ") & first.rlike(r"^\p{Ll}"))
        | (before.rlike("\n[IVXLCDM]+$") & (gap == "\n"))
        | before.endswith('—"')
        | (before.endswith(";") & (gap == " ") & first.isin("'", '"'))
        | after.startswith("—")
        | (before.endswith(":") & gap.isin(" ", "\n") & first.rlike(r"^\p{Lu}"))
    )
    return F.coalesce(filled & neutral & good, F.lit(False))
