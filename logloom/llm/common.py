"""What several operators share: tables, words, folds, written intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.sources.materialize import materialize

#: Characters between words: the six ASCII white space characters.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str) -> Column:
    """0 for held-out documents, 1 to 4 for the others; null ids fall to 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def words(text: Column) -> Column:
    """Words of a text; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def tokenizer_path() -> str:
    """The public vocabulary; queries name it, operators take a path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Bits of a sieve, in rows of 4 KB as Spark's bitmaps have them: 2 MB, whatever it is made from.
SIEVE = 1 << 24


def sifted(rows: DataFrame, ids: DataFrame, by: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``by`` may be among ``ids`` (one column), and those where it surely is not.

    Told by a table of bits, one for each hash that occurs among ``ids``. The latter rows need
    not move for a join; the former are joined as before, so results stay exact. Null is never
    among them. With very many ids it rules out little and costs nothing but itself.
    """
    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("long")), F.lit(SIEVE)) + 1

    own = place(F.col(ids.columns[0]))
    bits = materialize(ids.groupBy(F.bitmap_bucket_number(own).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias("bits")))
    key = rows[by]
    bit = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(bits["bits"], (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(key.isNotNull() & (F.getbit(byte, (bit % 8).cast("int")) == 1), F.lit(False))
    told = rows.join(bits, F.bitmap_bucket_number(place(key)) == bits["bucket"], "left")
    columns = [rows[f"`{c}`"] for c in rows.columns]
    return told.where(held).select(*columns), told.where(~held).select(*columns)


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` at its end, in place of any of the same name."""
    clash = {c.lower() for c in columns}
    kept = [c for c in df.columns if c.lower() not in clash]
    return df.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in columns.items()])


__all__ = ["FOLDS", "SPACE", "WORD", "fold", "materialize", "replaced", "sifted", "table", "tokenizer_path", "word_count", "words"]
