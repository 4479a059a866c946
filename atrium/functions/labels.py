"""Label, id and text functions as Column expressions."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import ALIAS_TO_TYPE, STAT_GROUPS


def lookup(values: dict, col: Column) -> Column:
    """Literal map lookup, NULL when the key is unknown."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.try_element_at(m, col)


def norm_label(col: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(col)), "[^a-z0-9]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def canonical_type(df: DataFrame, label: str, out: str = "type", extra: DataFrame | None = None) -> DataFrame:
    """Canonical room type of a native label; rows of ``extra`` (label, type) win over the built-in aliases.

    The extra table is a plain join: it may have any size, so Spark decides whether to broadcast it.
    """
    d = df.withColumn("__n", norm_label(F.col(label)))
    base = lookup(ALIAS_TO_TYPE, F.col("__n"))
    if extra is None:
        return d.withColumn(out, F.coalesce(base, F.lit("other"))).drop("__n")
    x = extra.select(norm_label(F.col("label")).alias("__n"), F.col("type").alias("__t")).groupBy("__n").agg(
        F.min("__t").alias("__t"))
    return d.join(x, "__n", "left").withColumn(out, F.coalesce("__t", base, F.lit("other"))).drop("__n", "__t")


def type_group(col: Column, groups: dict = STAT_GROUPS) -> Column:
    return F.coalesce(lookup(groups, col), col)


def gt_base_id(col: Column) -> Column:
    return F.regexp_replace(col, "_[0-9]+$", "")


def storey_base_id(col: Column) -> Column:
    return F.regexp_replace(col, "_s[0-9]+$", "")


def slug(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col), " ", "_"), "-", "")


def file_key(col: Column) -> Column:
    return F.regexp_replace(col, "[:/]", "_")


def fmt_cell(col: Column, digits: int = 2, percent: bool = False) -> Column:
    """Number as text, a dash for missing values."""
    v = col * 100 if percent else col
    txt = F.format_string(f"%.{digits}f" + ("%%" if percent else ""), v.cast("double"))
    return F.when(col.isNull(), F.lit("–")).otherwise(txt)


def feet_inches(col: Column) -> Column:
    """``9'8"`` to metres, NULL when the text holds no such measure."""
    pat = "([0-9]+)' *([0-9]+)\""
    ft, inch = F.regexp_extract(col, pat, 1), F.regexp_extract(col, pat, 2)
    return F.when(ft != "", (ft.cast("double") + inch.cast("double") / 12) * 0.3048)


def keyword_type(col: Column, words: list[tuple[str, list[str]]]) -> Column:
    """Type of the first entry one of whose words occurs in the text."""
    low = F.lower(col)
    tests = []
    for t, ws in words:
        hit = F.lit(False)
        for w in ws:
            hit = hit | low.contains(w)
        tests.append(F.when(hit, F.lit(t)))
    return F.coalesce(*tests)


def number_repeats(df: DataFrame, keys: list[str], name: str, order: list, large: DataFrame | None = None,
                   out: str = "label") -> DataFrame:
    """Number a name when it repeats inside its group: ``bedroom 1``, ``bedroom 2``, ``kitchen``."""
    from ..operators.ranking import rank_within
    d = rank_within(df, [*keys, name], order, "__k", large)
    n = df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("__n"))
    d = d.join(n, [*keys, name])
    label = F.when(F.col("__n") > 1, F.concat_ws(" ", F.col(name), (F.col("__k") + 1).cast("string"))).otherwise(F.col(name))
    return d.withColumn(out, label).drop("__k", "__n")


def strict_json(col: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else, else NULL.

    The parser ignores text after a value, so the value is parsed as the only element of an array.
    """
    v = F.try_parse_json(F.concat(F.lit("["), col, F.lit("]")))
    one = F.try_variant_get(v, "$[1]", "variant").isNull()
    return F.when(v.isNotNull() & one, F.try_variant_get(v, "$[0]", "variant"))
