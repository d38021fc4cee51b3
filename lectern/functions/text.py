"""Text functions as Column expressions: trimming, answers, verdicts, options, prompts, years, genres, labels.

Offsets count code points. Blank means Unicode white space wherever a text is
stripped, which ``F.trim`` alone does not cover.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space inside a character class, in a form that Java and RE2 read alike.
BLANK = r"\s\p{Z}\x1c-\x1f\x85"
_THINK = r"(?is)<think>.*?</think>"


def stripped(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, f"^[{BLANK}]+", ""), f"[{BLANK}]+$", "")


def trim_bounds(s: Column, start: Column, end: Column) -> Column:
    """struct(text, start_index, end_index) of a half-open span without the blanks around it; the end becomes inclusive (F-TRIM)."""
    left = F.length(s) - F.length(F.regexp_replace(s, f"^[{BLANK}]+", ""))
    right = F.length(s) - F.length(F.regexp_replace(s, f"[{BLANK}]+$", ""))
    return F.struct(stripped(s).alias("text"), (start + left).cast("int").alias("start_index"), (end - right - 1).cast("int").alias("end_index"))


def token_count(s: Column) -> Column:
    """Words and single marks, the offline stand-in for a model's tokenizer (F-TOK)."""
    return F.size(tokens(s))


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def word_count(s: Column) -> Column:
    """1.2 times the number of words, rounded; 0 for a blank text (F-WC)."""
    clean = stripped(s)
    n = F.when(F.length(clean) == 0, F.lit(0)).otherwise(F.size(F.split(clean, f"[{BLANK}]+")))
    return F.round(n * F.lit(1.2)).cast("int")


def _after_think(raw: Column) -> Column:
    return stripped(F.element_at(F.split(raw, "(?i)</think>"), -1))


def _filled(s: Column) -> Column:
    return F.when(F.length(s) > 0, s)


def extract_answer(raw: Column) -> Column:
    """What follows the first answer marker outside thoughts, else what follows the thoughts, else all (F-ANS)."""
    clean = F.regexp_replace(raw, _THINK, "")
    marked = stripped(F.regexp_extract(clean, r"(?is)answers?\s*:\s*(.*)", 1))
    return F.coalesce(_filled(marked), _filled(_after_think(raw)), stripped(raw))


def extract_verdict(raw: Column) -> Column:
    """'correct' or 'incorrect'; the latter wins, and stands for anything unclear, empty or null (F-VER)."""
    clean = F.regexp_replace(raw, _THINK, "")
    said = F.when(clean.rlike(r"(?i)verdict\s*:"), F.regexp_extract(clean, r"(?is)verdict\s*:\s*(.*)", 1)).otherwise(_after_think(raw))
    low = F.lower(said)
    good = low.contains("correct") & ~low.contains("incorrect")
    return F.when(F.coalesce(good, F.lit(False)), "correct").otherwise("incorrect")


def map_option(answer: Column, options: Column) -> Column:
    """The option that a letter names, or the answer as it is (F-OPT)."""
    letter = F.upper(stripped(answer))
    named = F.when(letter.rlike("^[A-Z]$"), F.get(options, F.ascii(letter) - 65))
    return F.coalesce(named, answer)


def context_block(chunks: Column) -> Column:
    """Numbered chunks, one under another (F-CTX)."""
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c)), "\n")


def option_block(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


_READER = "You answer questions about a book from the passages given."
_CHOICE = f"{_READER} Reply with one line of the form 'Answer: <letter>' and nothing else."
_OPEN = f"{_READER} Reply with one line of the form 'Answer: <answer>', in one or two sentences, and nothing else."
_JUDGE = "You compare a candidate answer with reference answers. It is correct if it means the same as any of them; if in doubt it is incorrect. Reply with one line: 'Verdict: correct' or 'Verdict: incorrect'."
_SPLITTER = "The passages of a document follow, each as 'ID n: text'. Name the first passage, other than the first of all, where the content turns to something new. Avoid very long groups. Reply with 'Answer: ID n' and nothing else."


def generation_prompt(question: Column, options: Column, chunks: Column) -> Column:
    """struct(system, user); the form with letters where there are options (F-PROMPT-G)."""
    ask, context = F.concat(F.lit("Question:\n"), question), F.concat(F.lit("\n\nContext:\n"), context_block(chunks))
    choice = F.concat(ask, F.lit("\n\nOptions:\n"), option_block(options), context, F.lit("\n\nReply only: Answer: <letter>"))
    free = F.concat(ask, context, F.lit("\n\nReply only: Answer: <answer>"))
    mcq = options.isNotNull()
    return F.struct(F.when(mcq, _CHOICE).otherwise(_OPEN).alias("system"), F.when(mcq, choice).otherwise(free).alias("user"))


def judge_prompt(question: Column, gold: Column, answer: Column) -> Column:
    """struct(system, user) for a judge (F-PROMPT-J)."""
    user = F.concat(F.lit("Question:\n"), question, F.lit("\n\nReference answers:\n"), F.array_join(gold, "\n"), F.lit("\n\nCandidate answer:\n"), answer)
    return F.struct(F.lit(_JUDGE).alias("system"), user.alias("user"))


def boundary_prompt(sentences: Column, first: Column) -> Column:
    """struct(system, user) that asks where the content turns (F-PROMPT-L)."""
    lines = F.array_join(F.transform(sentences, lambda s, i: F.concat(F.lit("ID "), (first + i).cast("string"), F.lit(": "), s)), "\n")
    return F.struct(F.lit(_SPLITTER).alias("system"), F.concat(F.lit("\nDocument:\n"), lines).alias("user"))


def boundary_id(output: Column) -> Column:
    """The id in 'Answer: ID n', else the first 'ID n', else null (F-LID)."""
    first = F.regexp_extract(output, r"Answer:\s*ID\s*(\d+)", 1)
    other = F.regexp_extract(output, r"\bID\s+(\d+)\b", 1)
    return F.coalesce(_filled(first), _filled(other)).cast("long")


def clean_year(s: Column) -> Column:
    """The year in 'L.M. Name 1828', '1853-1857' or '1900.0'; null for anything else (F-YEAR)."""
    x = stripped(s)
    x = F.when(x.startswith("L.M"), F.element_at(F.split(x, r"\s+"), -1)).otherwise(x)
    x = F.when(x.contains("-"), F.element_at(F.split(x, "-"), 1)).otherwise(x)
    return x.try_cast("double").cast("int")


def best_year(published: Column, fallback: Column) -> Column:
    return F.when(published.isNotNull() & (published != "ann"), clean_year(published)).otherwise(clean_year(fallback))


def genre_tags(s: Column) -> Column:
    """Trimmed parts between semicolons, blanks dropped; none for null (F-GENRE)."""
    parts = F.transform(F.split(F.coalesce(s, F.lit("")), ";"), stripped)
    return F.filter(parts, lambda x: F.length(x) > 0)


def fixed_point(x: Column, places: int) -> Column:
    """A number to one or two places as C prints it: by the exact value of the double, halves to even.

    ``format_string`` rounds the shortest decimal that names the double, which differs: 0.125 is 0.13 there, and 1.005,
    which is a little less, 1.01. Beyond 2**62 units of
    the last place it is used nevertheless. Null stays null.
    """
    scale = 10**places
    a = F.abs(x.cast("double"))
    # a * scale is product + rest, exactly: the halves of a have few enough bits for products without rounding.
    big = a * F.lit(134217729.0)
    high = big - (big - a)
    product = a * F.lit(float(scale))
    rest = (high * F.lit(float(scale)) - product) + (a - high) * F.lit(float(scale))
    whole = F.floor(product)
    part = product - whole
    # Above 2**52 a product has no fraction of its own, but its rest may go past a half, or more than one.
    shift = F.when(part == 0, F.floor(rest)).otherwise(F.lit(0).cast("long"))
    base = whole + shift
    beyond = F.when(part == 0, (rest - shift) - 0.5).otherwise((part - 0.5) + rest)
    n = base + F.when((beyond > 0) | ((beyond == 0) & (base % 2 != 0)), 1).otherwise(0)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    digits = F.lpad((n % scale).cast("string"), places, "0")
    plain = F.concat(sign, F.call_function("div", n, F.lit(scale)).cast("string"), F.lit("."), digits)
    return F.when(a * scale < float(1 << 62), plain).when(a.isNotNull(), F.format_string(f"%.{places}f", x.cast("double")))


def format_seconds(x: Column) -> Column:
    """Seconds as text in s, min or h (F-FMT)."""
    of = lambda y, unit: F.concat(fixed_point(y, 2), F.lit(f" {unit}"))
    return F.when(x.isNull(), "").when(x < 60, of(x, "s")).when(x < 3600, of(x / 60, "min")).otherwise(of(x / 3600, "h"))


def percent(part: Column, whole: Column) -> Column:
    """A share as text (F-PCT)."""
    return F.concat(fixed_point(100 * part / whole, 1), F.lit("%"))


def label(*parts: Column) -> Column:
    return F.concat_ws(" | ", *parts)


def label_with(name: Column, params: Column) -> Column:
    return F.when(params.isNull() | (params == ""), name).otherwise(F.concat(name, F.lit(" ("), params, F.lit(")")))


def first_different_line(a: Column, b: Column) -> Column:
    """The number, from 1, of the first line in which two texts differ; null if in none (F-DIFF)."""
    x, y = F.split(a, "\n"), F.split(b, "\n")
    differs = F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q))
    at = F.array_position(differs, True)
    return F.when(at > 0, at)


def contains_text(s: Column, part: Column) -> Column:
    return F.contains(s, part)


def first_items(xs: Column, n: int = 10) -> Column:
    return F.slice(xs, 1, n)


def ranks(xs: Column) -> Column:
    """[1, 2, ...] as long as the list, empty for none (F-RANKS)."""
    n = F.coalesce(F.size(xs), F.lit(0))
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def key_parts(key: Column, names: tuple[str, str, str, str] = ("chunking", "preset", "embed", "embed_preset")) -> Column:
    """Exactly four parts between hyphens as a struct; anything else fails the query (F-KEY)."""
    p = F.split(key, "-")
    checked = F.when(F.size(p) == 4, p).otherwise(F.raise_error(F.concat(F.lit("key without four parts: "), key)).cast("array<string>"))
    return F.struct(*[F.element_at(checked, i + 1).alias(n) for i, n in enumerate(names)])
