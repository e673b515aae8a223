"""Text of labels and tokens as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token vocabulary's limits and the wire format.
SEPARATOR, GRID, Y_SHIFT = 450, 224, 225
TOKEN = r"<ink_token_(\d+)>"
SENTINEL = r"<extra_id_\d+>|</s>|<pad>"
LATEX_TOKEN = r"(?s)\\(?:begin|end)\{[A-Za-z*]+\}|\\[A-Za-z]+|\\.|."
#: The first of the supplementary private characters.
PRIVATE = 0xF0000
#: Names of functions that a formula writes upright; a writer without such a symbol spells them.
OPERATOR_NAMES = (
    "sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh coth log ln lg exp lim liminf limsup max min sup inf det dim ker deg gcd arg hom Pr mod bmod"
).split()
IDENTIFIER = r"^[A-Za-z][A-Za-z0-9_-]*$"


def tokens_of(text: Column) -> Column:
    """Numbers of the ink tokens in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), lambda t: t.cast("int"))


def plain(text: Column) -> Column:
    """A text without ink tokens and model sentinels, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(text, TOKEN, ""), SENTINEL, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def wire(tokens: Column) -> Column:
    """Tokens as text."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("<ink_token_"), t.cast("string"), F.lit(">"))), "")


def latex_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LATEX_TOKEN), F.lit(0))


def char_tokens(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def normal_label(text: Column) -> Column:
    """Case-folded letters a-z and digits only; sharp s counts as ss."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "ß", "ss"), "[^a-z0-9]", "")


def left_padded(ids: Column, width: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(0), (width - F.size(ids)).cast("int")), ids)


def wrapped(words: Column, limit: int) -> Column:
    """Greedy lines of at most ``limit`` characters; a longer word has a line of its own."""

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = F.coalesce(F.length(last) + 1 + F.length(w) <= limit, F.lit(False))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), w)))
        return F.when(fits, grown).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token lists: each different token of the two becomes one private character, of which there are 131,068."""

    def distance(known: Column) -> Column:
        one = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, t) + (PRIVATE - 1)), 8, "0")), "UTF-32")
        coded = lambda x: F.array_join(F.transform(x, one), "")
        return F.when(F.size(known) > 131_068, F.raise_error(F.lit("too many different tokens"))).otherwise(F.levenshtein(coded(a), coded(b)))

    # an array of one, so that the tokens are listed once for each pair and not for each token
    return F.transform(F.array(F.array_distinct(F.concat(a, b))), distance)[0]


def words(text: Column) -> Column:
    """The words between white space as tokens."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def reply_formula(reply: Column, field: str = "latex") -> Column:
    """The formula in a model's JSON reply, without white space, back quotes and dollar signs around it; null where the reply is no JSON or has none."""
    bare = F.trim(F.btrim(F.trim(F.get_json_object(reply, f"$.{field}")), F.lit("`")))
    return F.trim(F.btrim(bare, F.lit("$")))


def spelled(tokens: Column, known: Column) -> Column:
    """Tokens with the names of functions that aren't ``known`` spelled letter by letter."""
    letters = lambda t: F.filter(F.split(F.substr(t, F.lit(2), F.length(t)), ""), lambda c: c != "")
    named = lambda t: t.startswith("\\") & F.substr(t, F.lit(2), F.length(t)).isin(OPERATOR_NAMES) & ~F.array_contains(known, t)
    return F.flatten(F.transform(tokens, lambda t: F.when(named(t), letters(t)).otherwise(F.array(t))))
