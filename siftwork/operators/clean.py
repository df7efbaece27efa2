"""Paper-table cleaning: title filter, strip, HTML to text, keep-first dedup,
strict label cast, title+abstract join, order-free dataset fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import html_to_text, normalise_key, strip_unicode

REQUIRED = ("title", "abstract", "label")


def require_columns(df: DataFrame, cols=REQUIRED) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def strict_bool(c) -> F.Column:
    """Boolean label cast that rejects NULL and unknown strings instead of guessing."""
    x = F.col(c) if isinstance(c, str) else c
    s = F.lower(strip_unicode(x.cast("string")))
    return (F.when(s.isin("true", "1", "1.0", "yes"), F.lit(True))
            .when(s.isin("false", "0", "0.0", "no"), F.lit(False))
            .otherwise(F.raise_error(F.concat(F.lit("bad label: "), F.coalesce(s, F.lit("NULL"))))
                       .cast("boolean")))


def dedup_keep_first(df: DataFrame, key: F.Column, id_col: str = "id") -> DataFrame:
    """Keep the row with the smallest id per key; a row without an id only where no other has one (of
    several such rows the least by a hash).

    The key is hashed (SHA-256) and each key keeps its row of the least id: one partial
    aggregate over the rows, so a key shared by a third of all rows is combined
    map-side, and the input is computed once."""
    # an order that is never null: min_by passes over null orders, and would lose rows without an id
    whole = F.struct(*[F.col(c) for c in df.columns])
    row = F.min_by(whole, F.struct(F.col(id_col).isNull(), F.col(id_col), F.when(F.col(id_col).isNull(), F.xxhash64(*df.columns)))).alias("_row")
    return df.groupBy(F.sha2(key, 256).alias("_k")).agg(row).select("_row.*")


def clean_papers(df: DataFrame, id_col: str = "id", null_abstract: str = "empty",
                 dedup: bool = True) -> DataFrame:
    """Drop rows without a title (NULL or length 0, checked before stripping, so a
    whitespace-only title survives), strip, HTML to text, dedup on the lower-cased,
    whitespace-collapsed ``title || abstract``, strict boolean label.

    ``null_abstract``: 'empty' (default) turns a NULL abstract into '', 'literal'
    keeps the study's accidental string 'nan'."""
    require_columns(df)
    fill = {"empty": "", "literal": "nan"}[null_abstract]
    x = df.where(F.length("title") > 0)
    # html_to_text ends with a whitespace collapse that also strips both ends
    x = x.withColumn("title", html_to_text("title")) \
         .withColumn("abstract", html_to_text(F.coalesce(F.col("abstract"), F.lit(fill))))
    if dedup:
        key = normalise_key(F.concat(F.col("title"), F.lit(" || "), F.col("abstract")))
        x = dedup_keep_first(x, key, id_col)
    return x.withColumn("label", strict_bool("label"))


def join_title_abstract(df: DataFrame, sep: str = " ", out: str = "text") -> DataFrame:
    """title + sep + abstract (NULLs become '' explicitly; concat_ws would drop the separator)."""
    return df.withColumn(out, F.concat(F.coalesce("title", F.lit("")), F.lit(sep),
                                       F.coalesce("abstract", F.lit(""))))


def label_display(c: str = "label") -> F.Column:
    return F.when(F.col(c), F.lit("Included")).otherwise(F.lit("Excluded"))


def text_fingerprint(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Order-free dataset fingerprint: row count, sum and XOR of the first 60 bits of each
    row's SHA-1. Rows are hashed in parallel and combined by partial aggregation; the
    study's order-dependent digest of the concatenation would need one task for the
    whole table, so it is offered only as ``text_fingerprint_ordered`` for small inputs."""
    h = F.conv(F.substring(F.sha1(F.col(text_col).cast("binary")), 1, 15), 16, 10)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
                  F.bit_xor(h.cast("long")).alias("hash_xor"))


def text_fingerprint_ordered(df: DataFrame, text_col: str = "text", order_col: str = "id") -> DataFrame:
    """SHA-1 of texts each followed by a newline, in ``order_col`` order (single group:
    small tables only, e.g. a cache key for a few thousand papers)."""
    s = F.expr(f"listagg(concat({text_col}, '\\n'), '') within group (order by {order_col})")
    return df.agg(F.sha1(s.cast("binary")).alias("sha1"))


# Fixed values of the digest: a prime below 2^31 and two bases, so that products stay in 64 bits.
DIGEST_PRIME = 2_147_483_647
DIGEST_BASES = (1_103_515_245, 214_013_377)
_DIGEST_BITS = 48  # rows up to 2^48


def sequence_fingerprint(df: DataFrame, order_cols, text_col: str = "text") -> DataFrame:
    """Digest of a table's texts in the order of ``order_cols`` (a total order; nulls first): (n_rows, digest_1, digest_2).

    A sequence's digest is (length, hash) with hash = sum of h_i * B^i modulo a prime over its places i, h_i 31 bits of a
    text's SHA-1. Two digests combine in order, (n + m, a + B^n * b), which is associative, so each row adds
    h_i * B^i from its own place and partial sums meet in any order. Places come from ``running_totals``, whose blocks keep
    a table out of one task. It changes when two different texts swap, whatever the partitioning. A null text counts as empty."""
    from siftwork.operators.prefix import key_block, running_totals
    order_cols = list(order_cols)
    rows = df.select(*order_cols, F.conv(F.substring(F.sha1(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long").alias("_h"), F.lit(1).cast("long").alias("_one"))
    placed = running_totals(rows, [], [F.col(c).asc_nulls_first() for c in order_cols], ["_one"], key_block(df, order_cols[0]), prefix="_upto")

    def power(base: int, place):
        steps, square = [], base % DIGEST_PRIME
        for bit in range(_DIGEST_BITS):
            steps.append(F.when(F.shiftright(place, bit).bitwiseAND(F.lit(1)) == 1, F.lit(square)).otherwise(F.lit(1)).cast("long"))
            square = square * square % DIGEST_PRIME
        return F.aggregate(F.array(*steps), F.lit(1).cast("long"), lambda a, b: a * b % DIGEST_PRIME)

    terms = [(F.col("_h") * power(base, F.col("_upto_one") - 1)) % DIGEST_PRIME for base in DIGEST_BASES]
    return placed.agg(F.count(F.lit(1)).alias("n_rows"), *((F.coalesce(F.sum(t), F.lit(0)) % DIGEST_PRIME).cast("long").alias(f"digest_{k}") for k, t in enumerate(terms, 1)))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Counts and shares per label value (aggregate first; the share window runs over
    the few aggregated rows only)."""
    from pyspark.sql import Window
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
