"""k-mers as numbers: two bits a base, so that scans, counts and joins of k-mers work on integers.

A sequence is cut into words of LETTERS bases that overlap by k - 1; a word is one 64-bit number and a mask of its unknown
bases. The k-mers of a word are shifts of these, in code that the engine generates: no k-mer is a string before it is shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"
#: Bases of a word: two bits each, below the sign.
LETTERS = 31


def kmer_text(kmer: Column, k: int = 5) -> Column:
    """The letters of a packed k-mer."""
    return F.concat(*[F.substring(F.lit(BASES), F.shiftright(kmer, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)) for i in range(k)])


def kmer_number(text: Column) -> Column:
    """The packed form of a k-mer of A, C, G, T; null for other letters."""
    return F.when(text.rlike("^[ACGT]+$"), F.conv(F.translate(text, BASES, "0123"), 4, 10).cast("long"))


def packed_kmers(rows: DataFrame, seq: str, k: int = 5, keep: list[str] | None = None) -> DataFrame:
    """(keep, place, kmer): every k-mer of the sequences (upper case; any letter but A, C, G, T is unknown), its place from
    0 on and its number; k-mers with an unknown base are left out, but the place goes on. Linear in the sequence: words are
    cut from its bytes."""
    if not 1 <= k <= 15:
        raise ValueError("a k-mer has 1 to 15 bases")
    step = LETTERS - k + 1
    clean = F.when(F.col(seq).rlike("[^ACGT]"), F.regexp_replace(F.col(seq), "[^ACGT]", "N")).otherwise(F.col(seq))
    out = rows.select(*(keep or []), clean.cast("binary").alias("_s")).filter(F.octet_length("_s") >= k)
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.octet_length("_s") - k, F.lit(step))).alias("_at"))
    out = out.select(*(keep or []), "_at", F.substring("_s", F.col("_at") + 1, F.lit(LETTERS)).cast("string").alias("_w"))
    word = F.conv(F.translate("_w", BASES + "N", "01230"), 4, 10).cast("long")
    mask = F.when(F.contains("_w", F.lit("N")), F.conv(F.translate("_w", BASES + "N", "00001"), 2, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    out = out.select(*(keep or []), "_at", F.length("_w").alias("_n"), word.alias("_word"), mask.alias("_mask"))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("_n") - k, F.lit(step - 1)))).alias("_i"))
    down = F.col("_n") - k - F.col("_i")
    unknown = F.expr("shiftright(_mask, _d)").bitwiseAND(F.lit((1 << k) - 1))
    number = F.expr("shiftright(_word, 2 * _d)").bitwiseAND(F.lit((1 << 2 * k) - 1))
    out = out.withColumn("_d", down).filter(unknown == 0)
    return out.select(*(keep or []), (F.col("_at") + F.col("_i")).alias("place"), number.alias("kmer"))
