"""Fill-in-the-middle examples: a text cut twice at random token borders and put together in another order.

A text's tokens are ``[A-Za-z]+|[^A-Za-z]``, but they are never listed. Maximal runs of letters and of other code points are held with
the number of units before each: a run of letters is one unit, any other run has a unit a code point. The run that contains a cut is
found by binary search in these counts, and the place in it by subtraction.

The digest of ``<seed>:<doc_id>`` gives four numbers: two for the cuts, one for whether the text is transformed at all, one for
the order (``psm`` or ``spm``). A text that is empty or contains a mark stays plain, so an output can always be taken apart again.

Defined results: null text is empty; a null id is hashed as the empty string; rows that repeat an id are cut by the same numbers; an
empty table gives an empty result; all columns of the input come back, and one named like the new column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import text_chunks

SEED, TRANSFORMED, SPM = "1", 90, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RESULT = "struct<output: string, form: string, n: bigint, prefix_chars: bigint, middle_chars: bigint>"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class ClassRuns:
    """Maximal runs of one class within the texts that ``offsets`` bounds in UTF-8 ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        letter, self.heads = _LETTER[data], (data & 0xC0) != 0x80
        begins = np.ones(len(data), bool)
        begins[1:] = letter[1:] != letter[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(begins)
        points = np.add.reduceat(self.heads, start, dtype=np.int64) if len(start) else np.empty(0, np.int64)
        before = lambda x: np.concatenate(([0], np.cumsum(x)))
        self.start, self.point, self.unit = np.append(start, len(data)), before(points), before(np.where(letter[start], 1, points))
        first = np.searchsorted(self.start, offsets)
        self.first_point, self.first_unit = self.point[first], self.unit[first]
        self.units = np.diff(self.first_unit)

    def cut(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte and code point in ``data`` after so many units of each text."""
        unit = self.first_unit[:-1] + units
        run = np.searchsorted(self.unit, unit, "right") - 1
        inside = unit - self.unit[run]
        byte = self.start[run] + inside
        wide = np.flatnonzero(inside > 0)
        for k in wide.tolist():  # code points of several bytes are counted within their run
            lo, hi = self.start[run[k]], self.start[run[k] + 1]
            if hi - lo > self.point[run[k] + 1] - self.point[run[k]]:
                byte[k] = lo + np.flatnonzero(self.heads[lo:hi])[inside[k]]
        return byte, self.point[run] + inside


def _arranged(text: bytes, a: int, b: int, form: str) -> bytes:
    if form == "psm":
        return b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
    return b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))


def _transformer(at: int, transformed: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.num_columns - 4
            for lo, hi, data, offsets in text_chunks(b.column(at)):
                part = b.slice(lo, hi - lo)
                h = [part.column(kept + k).to_numpy() for k in range(4)]
                runs = ClassRuns(data, offsets)
                cuts = h[0] % (runs.units + 1), h[1] % (runs.units + 1)
                (a, a_point), (e, e_point) = runs.cut(np.minimum(*cuts)), runs.cut(np.maximum(*cuts))
                out: dict[str, list] = {"output": [], "form": []}
                for k in range(hi - lo):
                    text = data[offsets[k] : offsets[k + 1]].tobytes()
                    form = "plain" if not text or h[2][k] % 100 >= transformed or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) else "spm" if h[3][k] % 100 < spm else "psm"
                    out["form"].append(form)
                    out["output"].append(text if form == "plain" else _arranged(text, a[k] - offsets[k], e[k] - offsets[k], form))
                plain = np.array([f == "plain" for f in out["form"]], bool)
                made = [
                    pa.array(out["output"], pa.binary()).cast(pa.string()), pa.array(out["form"], pa.string()), pa.array(runs.units, pa.int64()),
                    pa.array(a_point - runs.first_point[:-1], pa.int64(), mask=plain), pa.array(e_point - a_point, pa.int64(), mask=plain),
                ]
                fields = [pa.field(n, c.type) for n, c in zip(("output", "form", "n", "prefix_chars", "middle_chars"), made, strict=True)]
                columns = [*part.columns[:kept], pa.StructArray.from_arrays(made, fields=fields)]
                yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(kept + 1)])

    return run


def fill_in_middle(documents: DataFrame, out: str = "fim", seed: str = SEED, transformed: int = TRANSFORMED, spm: int = SPM) -> DataFrame:
    """All columns of documents and ``out``, a struct: the output, its form (plain, psm or spm), the number of tokens, and the code points of prefix
    and middle (null where plain). ``transformed`` in 100 texts are transformed, ``spm`` in 100 of them suffix first."""
    names = [c for c in documents.columns if c != out]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"{'_'.join(names)}_{k}") for k in range(4)]
    rows = documents.select(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in names], *numbers)
    schema = T.StructType([*rows.schema.fields[: len(names)], T.StructField(out, T._parse_datatype_string(RESULT))])
    return rows.mapInArrow(_transformer(names.index("text"), transformed, spm), schema)


def restored(fim: str = "fim") -> Column:
    """The text that a transformed row was made of."""
    piece = lambda k: F.split(F.col(f"{fim}.output"), "<[PSM]>")[k]
    form = F.col(f"{fim}.form")
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(F.col(f"{fim}.output"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = fill_in_middle(documents)
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS us,
  CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(us) AS BIGINT) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:n], '') AS s,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
