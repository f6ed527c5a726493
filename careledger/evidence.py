"""Whether a span backs a value: folding that keeps Indic scripts, and echoes of texts, numbers, lists and booleans.

A fact's value is a text column, or a VARIANT, whose entries keep their own types.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from careledger.canonical import json_number

# What folding keeps (letters a to z, digits, and the scripts from Devanagari to Sinhala), and what makes a word of a text.
KEPT = "a-z0-9ऀ-෿"
WORD_OF_SCRIPT = "[a-zA-Zऀ-෿]{3,}"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
#: Letters whose case folding is more than lower case, as far as it gives letters a to z.
FOLDS_TO = {"ß": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: What can be read as one quantity.
_QUANTITY = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NO_QUANTITY = r"^(?i)[+-]?(inf(inity)?|nan)$"


def casefolded(text: Column) -> Column:
    out = F.lower(text)
    more = out
    for letter, folded_to in FOLDS_TO.items():
        more = F.replace(more, F.lit(letter), F.lit(folded_to))
    return F.when(out.rlike("[" + "".join(FOLDS_TO) + "]"), more).otherwise(out)


def folded(text: Column) -> Column:
    """A text in folded case, all but letters and digits of the kept scripts as one space."""
    return F.trim(F.regexp_replace(casefolded(text), f"[^{KEPT}]+", " "))


def words_of(text: Column) -> Column:
    """Words of three letters or more in any of the kept scripts, in folded case."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD_OF_SCRIPT), F.lit(0)), F.lower)


def _said(parts: tuple[Column, ...]) -> Column:
    """Everything a span offers; parts that are null or empty are left out, but for the first."""
    return F.concat_ws(" ", F.coalesce(folded(parts[0]), F.lit("")), *[F.when(p != "", folded(p)) for p in parts[1:]])


def value_is_echoed(value: Column, verbatim: Column, *more: Column) -> Column:
    """A text is backed by its span (``verbatim``, and a translation or a person's reading as ``more``): as folded text either way, as the same number, or by
    all its words of more than two letters. A number counts as its quantity only. A value without letters and digits is backed by nothing."""
    v, hay = folded(value), _said((verbatim, *more))
    bare = F.trim(value)
    number = F.when(bare.rlike(_QUANTITY), bare.try_cast("double"))
    numbers = F.transform(F.regexp_extract_all(F.concat_ws(" ", verbatim, *more), F.lit(NUMBER), F.lit(0)), lambda x: x.try_cast("double"))
    same = F.exists(numbers, lambda x: F.abs(x - number) < 1e-9)
    words = F.filter(F.split(v, " "), lambda w: F.length(w) > 2)
    all_words = (F.size(words) > 0) & F.forall(words, lambda w: hay.contains(w))
    out = F.when(v == "", False).when(hay.contains(v) | v.contains(hay), True).when(number.isNotNull(), same).when(bare.rlike(_NO_QUANTITY), False).otherwise(all_words)
    return F.coalesce(out, F.lit(False))


def kind_of(value: Column) -> Column:
    """list, text, or bare (numbers, booleans and null) of a variant."""
    schema = F.schema_of_variant(value)
    return F.when(schema.startswith("ARRAY"), "list").when(schema.startswith("STRING") | schema.startswith("OBJECT"), "text").when(schema.isNotNull(), "bare")


def members_of(value: Column) -> Column:
    """The entries of a variant's list; anything else is one entry."""
    return F.when(kind_of(value) == "list", F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))


def text_of(value: Column) -> Column:
    """A variant as the text that options are compared with: booleans with a capital letter, numbers with a point as such."""
    plain, kind = F.try_variant_get(value, "$", "string"), F.schema_of_variant(value)
    return F.when(kind == "BOOLEAN", F.initcap(plain)).when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), json_number(F.try_variant_get(value, "$", "double"))).otherwise(plain)


def texts_of(value: Column) -> Column:
    """The entries of a variant as texts; nulls are left out."""
    return F.filter(F.transform(members_of(value), text_of), lambda x: x.isNotNull())


def typed_value_is_echoed(value: Column, verbatim: Column, *more: Column, selected: Column | None = None) -> Column:
    """value_is_echoed of a variant: numbers and booleans need no echo, of a list every entry is asked for and an empty one has none.

    Where ``selected`` (the options that were pressed) is not null it alone decides: every entry must be among them.
    """
    one = lambda x: F.when(kind_of(x) == "bare", True).otherwise(value_is_echoed(F.try_variant_get(x, "$", "string"), verbatim, *more))
    listed = kind_of(value) == "list"
    entries = F.try_variant_get(value, "$", "array<variant>")
    echoed = F.when(listed, (F.size(entries) > 0) & F.forall(entries, one)).otherwise(one(value))
    if selected is not None:
        wanted = F.transform(members_of(value), text_of)
        echoed = F.when(selected.isNull(), echoed).otherwise((F.size(wanted) > 0) & F.forall(wanted, lambda x: F.array_contains(selected, x)))
    return F.coalesce(echoed, F.lit(False))


def in_vocabulary(value: Column, options: list[str]) -> Column:
    """Whether every entry of a variant is one of the options."""
    return F.forall(F.transform(members_of(value), text_of), lambda x: F.coalesce(x.isin(options), F.lit(False)))
