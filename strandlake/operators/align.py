"""Alignment of a read's blocks to the k-mers of its reference by dynamic programming, and its three simpler variants."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import windows_of
from . import kernels as K
from .signal import lists

_BLOCK = {"mu": "double", "sigma": "double", "start": "int", "end": "int", "len": "int"}
_STEPS = "_kmer array<string>, _pos array<int>, " + ", ".join(f"_{c} array<{t}>" for c, t in _BLOCK.items())


def align_reads(reads: DataFrame, model: dict[str, tuple[float, float, float, float]], keys: list[str], variant: str = "two", reference: str = "reference", origin: str | None = None) -> DataFrame:
    """One row for each step of each read's path. reads: keys, blocks (array of struct start, end, mu, sigma, len, in
    signal order), the reference sequence, and the position of its first k-mer's centre.

    model: the parameters of the 1025 k-mers at most, so it travels with the tasks. Variants: ``two`` and ``one``
    components with all four moves; ``ivt``: no gaps, the path may end anywhere from k-mer 400 on; ``reverse_ivt``: the
    signal keeps its order and the k-mers are reversed, the path may end anywhere. Blocks are reversed in the others, as
    the signal runs from the 3' end. Rows come in path order; a step without k-mer or block has nulls there. k-mers
    that the model lacks raise an error."""
    if variant not in ("two", "one", "ivt", "reverse_ivt"):
        raise ValueError(variant)
    one_way = variant in ("ivt", "reverse_ivt")
    kmers = windows_of(F.col(reference), 5)

    def field(c: str, kind: str):
        return F.transform("blocks", lambda x: x[c].cast(kind)).alias(f"_{c}")

    fields = [field(c, kind) for c, kind in _BLOCK.items()]
    rows = reads.select(*keys, "blocks", kmers.alias("_k"), (F.col(origin) if origin else F.lit(2)).cast("int").alias("_origin"))
    rows = rows.select(*keys, F.transform("_k", lambda x: x["kmer"]).alias("_kmer"), F.transform("_k", lambda x: x["pos"]).alias("_pos"), *fields, "_origin")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.select(*keys).schema.fields)
    names, parameters = pa.array(list(model), pa.string()), np.array(list(model.values()), dtype=float).reshape(len(model), -1)

    def paths(b: pa.RecordBatch) -> pa.RecordBatch:
        """Each read's path as arrays of its steps; the steps' values are taken from the columns all at once."""
        at = {c: b.schema.get_field_index(c) for c in ("_kmer", "_pos", "_origin", *(f"_{c}" for c in _BLOCK))}
        words, wa, wz = lists(b.column(at["_kmer"]))
        number = pc.index_in(words, names)
        if number.null_count:
            raise KeyError(words.filter(number.is_null())[0].as_py())
        number = number.to_numpy(zero_copy_only=False).astype(np.int64)
        levels, ba, bz = lists(b.column(at["_mu"]))
        mu = levels.to_numpy(zero_copy_only=False)
        of_block, of_word, origins, size = [], [], [], np.zeros(b.num_rows + 1, dtype=np.int32)
        for i in range(b.num_rows):
            blocks, kmer = np.arange(ba[i], bz[i]), np.arange(wa[i], wz[i])
            if variant == "reverse_ivt":
                kmer = kmer[::-1]
            else:
                blocks = blocks[::-1]
            if not len(blocks) or not len(kmer):
                continue
            models = parameters[number[kmer]]
            path = K.align(mu[blocks], models if variant == "two" else models[:, :2], (K.MATCH, K.STAY) if one_way else (K.MATCH, K.STAY, K.GAP, K.SKIP), -6.0 if one_way else -4.941642, {"ivt": 400, "reverse_ivt": 1}.get(variant))
            step = np.array(path, dtype=np.int64).reshape(-1, 3)
            of_block.append(np.where(step[:, 1] >= 0, blocks[step[:, 1]], -1))
            of_word.append(np.where(step[:, 2] >= 0, kmer[step[:, 2]], -1))
            origins.append(np.full(len(step), b.column(at["_origin"])[i].as_py()))
            size[i + 1] = len(step)
        none = [np.zeros(0, np.int64)]
        block, word, shift = (np.concatenate(x or none) for x in (of_block, of_word, origins))
        offsets = pa.array(np.cumsum(size, dtype=np.int32))
        block, word = (pa.array(x, mask=x < 0) for x in (block, word))
        taken = [words.take(word), pc.cast(pc.add(pc.cast(lists(b.column(at["_pos"]))[0].take(word), pa.int64()), pa.array(shift - 2)), pa.int32())]
        for c in _BLOCK:
            values = lists(b.column(at[f"_{c}"]))[0].take(block)
            taken.append(pc.fill_null(values, 0.0) if c in ("mu", "sigma") else values)
        columns = [*b.columns[: len(keys)], *(pa.ListArray.from_arrays(offsets, v) for v in taken)]
        return pa.RecordBatch.from_arrays(columns, [*b.schema.names[: len(keys)], "_kmer", "_pos", *(f"_{c}" for c in _BLOCK)])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # paths don't pile up over a batch of reads
                yield paths(b.slice(lo, 256))

    steps = rows.mapInArrow(run, f"{kinds}, {_STEPS}")
    zipped = F.arrays_zip(*[F.col(f"_{c}").alias(c) for c in ("kmer", "pos", *_BLOCK)])
    steps = steps.select(*keys, F.posexplode(zipped).alias("row_no", "_s"))
    return steps.select(*keys, *[F.col("_s")[c].alias(c) for c in ("kmer", "pos", *_BLOCK)], "row_no")


#: The k-mers of five letters over A, C, G, T and the one that stands for none.
MODELS = 4**5 + 1


def model_dict(kmer_model: DataFrame) -> dict[str, tuple[float, float, float, float]]:
    """The k-mer table on the driver. A table of more rows than there are k-mers is none: an error."""
    rows = kmer_model.limit(MODELS + 1).collect()
    if len(rows) > MODELS:
        raise ValueError(f"the k-mer table has more than {MODELS} rows")
    return {r.kmer: (r.mean_un, r.stdv_un, r.mean_mod, r.stdv_mod) for r in rows}
