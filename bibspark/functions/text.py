"""Normalisation of names, texts and identifiers.

What Spark SQL can express stays a Column expression. Unicode normal forms and case folding
have no equivalent there; they run in Arrow-batched functions, once for each different string
of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

# Words that tell of a group of people.
COLLECTIVE = ("collaboration", "consortium", "committee", "group", "initiative", "network", "team", "study", "investigators")
_OUTER = r"(?U)^\s+|\s+$"
_NOT_WORD = re.compile(r"[\W]+")


def strip_accents(value: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


def normalized(value: str) -> str:
    """Folded words of letters, digits and underscores, single spaced."""
    folded = strip_accents(unicodedata.normalize("NFKC", value)).casefold()
    return _NOT_WORD.sub(" ", folded).strip()


#: Rows of an Arrow batch that holds texts.
TEXT_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lets no Arrow batch of this session have more than TEXT_ROWS rows.

    Executors and their Python workers hold a batch several times over; rows with whole texts
    are large, and smaller batches change no result.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


#: Bytes of texts that are Python strings at once; a longer text is alone. It changes no result.
TEXT_BYTES = 1 << 20


def once_each(function: Callable[[str], object], values: pa.Array, kind: pa.DataType) -> pa.Array:
    """``function`` over a batch, called once for each different string of a slice; null stays null.

    A batch of long texts is large, so only a slice of it is held as Python objects; the rest is
    the batch itself and what has been made of it, both in Arrow's form.
    """
    size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.nonzero(np.diff(np.cumsum(size) // TEXT_BYTES))[0] + 1).tolist(), len(values)]

    def told(part: pa.Array) -> pa.Array:
        part = part.dictionary_encode()
        return pa.array((function(v.as_py()) for v in part.dictionary), kind).take(part.indices)

    parts = [told(values.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(StringType())
def accents_stripped(values: pa.Array) -> pa.Array:
    return once_each(strip_accents, values, pa.string())


@F.arrow_udf(StringType())
def normalize_text(values: pa.Array) -> pa.Array:
    return once_each(normalized, values, pa.string())


@F.arrow_udf(StringType())
def casefolded(values: pa.Array) -> pa.Array:
    return once_each(str.casefold, values, pa.string())


normalize_name = normalize_text


def normalize_surname(value: Column) -> Column:
    """A normalised text without its spaces."""
    return F.replace(normalize_text(value), F.lit(" "), F.lit(""))


def stripped(value: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(value, _OUTER, "")


def normalize_doi(value: Column) -> Column:
    """A bare lower-case DOI; null if nothing is left.

    DOIs are folded by lower(): the characters in which that differs from full case folding
    do not occur in registered DOIs.
    """
    bare = stripped(F.regexp_replace(stripped(value), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"""[.,;:)\]}>"']+$""", ""), r"""^[(\[{<"']+""", "")
    return F.nullif(F.lower(bare), F.lit(""))


def normalize_orcid(value: Column) -> Column:
    """A bare identifier; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(stripped(value)), "^https?://orcid[.]org/", ""), F.lit(""))


def short_openalex_id(value: Column) -> Column:
    """The last part of the identifier's URL, in its own case; null if nothing is left."""
    return F.nullif(F.substring_index(F.regexp_replace(stripped(value), "/+$", ""), "/", -1), F.lit(""))


def is_collective_name(name: Column) -> Column:
    """Whether a word of the normalised name tells of a group of people."""
    return F.coalesce(F.arrays_overlap(F.split(normalize_text(name), " "), F.array(*map(F.lit, COLLECTIVE))), F.lit(False))


@F.pandas_udf(ArrayType(BooleanType()))
def collective_names(names: pd.Series) -> pd.Series:
    """is_collective_name() of each name of an array; null for null."""
    known: dict[str, bool] = {}

    def told(name: str | None) -> bool | None:
        if name is not None and name not in known:
            known[name] = not set(normalized(name).split(" ")).isdisjoint(COLLECTIVE)
        return None if name is None else known[name]

    return pd.Series([None if row is None else [told(n) for n in row] for row in names], dtype=object)


def stable_work_key(work_id: Column, doi: Column) -> Column:
    """The DOI if there is one, else the work's own id."""
    return F.coalesce(F.concat(F.lit("doi:"), normalize_doi(doi)), work_id)


def identity_key(orcid: Column, openalex_id: Column, provider_id: Column, name: Column) -> Column:
    """One author's own key: the strongest identifier, else the normalised name."""

    def keyed(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), F.nullif(value, F.lit("")))

    return F.coalesce(keyed("orcid:", normalize_orcid(orcid)), keyed("openalex:", short_openalex_id(openalex_id)), keyed("provider:", stripped(provider_id)), F.concat(F.lit("name:"), normalize_name(name)))


def ordered_distinct(values: Column) -> Column:
    """Distinct values that aren't empty, first seen first."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def last_token(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def family_name(author: Column) -> Column:
    """The family name, or the last token of the displayed one."""
    return F.coalesce(F.nullif(author["family"], F.lit("")), last_token(author["display_name"]))


def signature(author: Column) -> Column:
    """Surname and initial of the given name, for cautious alignment."""
    family = family_name(author)
    shown = author["display_name"]
    rest = F.when(F.endswith(shown, family), F.substring(shown, F.lit(1), F.length(shown) - F.length(family))).otherwise(shown)
    given = F.coalesce(F.nullif(author["given"], F.lit("")), stripped(rest))
    return F.struct(normalize_surname(family).alias("surname"), F.substring(normalize_name(given), 1, 1).alias("initial"))
