"""Near-duplicate groups by SuperMinHash: signatures of correlated ranks, bands, verification, union-find.

Method. Of a set, each member draws a random permutation of the SLOTS places of a signature, step by step (the
Fisher-Yates way), and at step j offers j plus a random fraction to the place drawn; a place keeps the least offer. Two
sets agree in a place with a probability that is their Jaccard similarity, and as one member's offers to all places are
ranks of one permutation, the share of equal places varies less than with independent minima. Steps are taken for all
members of a batch at once; a set stops when each of its places holds less than the next step could offer, which for large
sets is after two or three steps instead of SLOTS.

Runs of ROWS places are bands, whose equality makes two sets candidates: at a similarity of 0.85 a pair is missed in all 32
bands with a probability of 6e-11, at 0.8 of 5e-8. Equal sets are one class beforehand. The sets of a band's bucket meet in
blocks; parity bitmaps bound overlaps from above, and what they admit is confirmed on the full sets, as sorted arrays.
Buckets of any size are worked through as in ``similarity``: blocks first, then what is still apart from a bucket's largest
component against all its rows. Components come from union-find, by contraction where links are many.

Results: one row per input row. Rows without words (null or empty text too) have an empty set, are in no link, and keep
their own id as component; rows of fewer words than a shingle have the whole sequence as its only one. Rows that are equal,
or have the same id, each get a row. Component ids are the least non-null id of the component, null if all are null.
``kept`` marks rows whose id is their component's (null ids of null components too). Columns other than id and text are ignored. Sets are told
apart by 64-bit hashes, and so are shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as w
from tessera.llm.common import cut, trimmed
from tessera.llm.similarity import FIRST, WHOLE, _linked, _named, _none, _texts, width

#: Places of a signature, and of a band.
SLOTS, ROWS = 128, 4
#: Bands that are worked through ahead of all; only the work depends on it.
AHEAD = 4
#: Shingles whose permutations are drawn at once.
DRAWN = 1 << 16

_U = np.uint64
_STEP = np.random.default_rng(0x5EEDED).integers(1, 1 << 63, (SLOTS, 2), dtype=np.uint64) | _U(1)
_FRACTION = _U(56)  # bits below the step's number


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """A row of ``slots`` 64-bit offers (step, fraction) for each set of hashes; sets must not be empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    x = np.concatenate(sets) if sets else np.zeros(0, _U)
    out = np.full((len(sets), slots), ~_U(0))
    flat = out.reshape(-1)
    places = None
    with np.errstate(over="ignore"):
        for j in range(slots if len(sets) else 0):
            drawn = j + (w.mix(x ^ _STEP[j, 0]) % _U(slots - j)).astype(np.int64)
            offer = (w.mix(x + _STEP[j, 1]) >> (_U(64) - _FRACTION)) | (_U(j) << _FRACTION)
            if places is None:
                place, first = drawn, drawn
            else:
                rows = np.arange(len(x))
                place = places[rows, drawn].astype(np.int64)
                places[rows, drawn] = places[rows, j]
            np.minimum.at(flat, owner * slots + place, offer)
            left = (out.max(1) >= (_U(j + 1) << _FRACTION))[owner]
            if j + 1 == slots or not left.any():
                break
            if places is None:
                x, owner, first = x[left], owner[left], first[left]
                places = np.broadcast_to(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint32), (len(x), slots)).copy()
                places[np.arange(len(x)), first] = 0
            elif 2 * np.count_nonzero(left) <= len(x):
                x, owner, places = x[left], owner[left], places[left]
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The bands' keys of each signature, as signed 64-bit numbers; those of different places differ."""
    n = signature.shape[1] // rows
    parts = signature[:, : n * rows].reshape(len(signature), n, rows)
    with np.errstate(over="ignore"):
        keys = w.mix((parts * w._LANES[:rows]).sum(2) + np.arange(n, dtype=_U) * w._LANES[40])
    return keys.view(np.int64)


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, sid, keys, bits) of each document."""
    names = ["doc_id", "n", "sid", "keys", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid, bits, keys, held, count = [], [], [], [], [], 0

            def drawn() -> None:
                found = iter(bands(signatures(held)).tolist())  # noqa: B023
                keys.extend(next(found) if m else None for m in n[len(keys) :])  # noqa: B023

            for s in w.shingle_sets(batch.column(1), k):
                n.append(len(s))
                sid.append(w.set_id(s) if len(s) else None)
                bits.append(w.bitmap(s, width(len(s))) if len(s) else None)
                if len(s):
                    held.append(s)
                    count += len(s)
                if count >= DRAWN:
                    drawn()
                    held, count = [], 0
            drawn()
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names)

    return docs.mapInArrow(trimmed(run), "doc_id long, n long, sid long, keys array<long>, bits binary")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, set_id) of each row: documents linked when den*|A & B| >= num*|A | B|.

    set_id tells the distinct sets apart, null for texts without words. The bands suit similarities of 0.8 or more.
    """
    docs = _texts(docs, id_col, text_col)
    found = cut(_profiles(docs, k))
    rows = found.select("doc_id", F.col("n").alias("n_shingles"), "sid")
    classes = cut(found.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("keys").alias("keys")))
    met = lambda keys: classes.select(F.explode(keys).alias("tile"), "sid", "n", F.lit(True).alias("early"))
    # near copies meet in most bands: a few of these join them, and the others hold little then but sets that are apart
    _, moved = _linked(met(F.slice("keys", 1, AHEAD)), _none(docs, "sid long, label long"), docs, classes, k, num, den, FIRST, banded=False)
    _, moved = _linked(met("keys"), moved, docs, classes, k, num, den, WHOLE, banded=False)
    named = _named(rows, classes, moved)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return named.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "set_id")
