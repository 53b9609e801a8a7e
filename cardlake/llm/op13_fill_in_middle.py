"""Fill-in-middle: DuckDB inside mapInArrow cuts each text at two places and puts the middle last.

A unit is a word with the white space before it, or white space at the end. Each batch of texts is registered with DuckDB, whose SQL cuts, draws and
joins for all of its rows; no Python code sees a row. Draws are the first four 8-digit groups of the SHA-256 of `seed:doc_id`, so a
document gets the same form wherever and however often it is computed. Batches hold some MB of text, a longer text is alone in one, and of a text of
more than LONG bytes the units are counted part by part, with the same result; a connection has one thread, and no folder to spill to.

Texts that hold a marker, empty and null texts stay plain. A null doc_id draws as an empty one. Rows are taken one by one: repeated rows give
repeated results, an empty table an empty one. Other columns stay; ones named like results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TEXT, ID = "__fim_text", "__fim_id"

#: Draws, cuts and forms of a batch. Slices are of units, from 1; a and b are the ends of prefix and middle.
CUT = rf"""
WITH d AS (SELECT {TEXT} AS t, sha256($seed || ':' || coalesce(CAST({ID} AS VARCHAR), '')) AS s FROM batch),
u AS (SELECT t, regexp_extract_all(t, '{UNIT}') AS x, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(s, i, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT t, x, h, CAST(len(x) AS BIGINT) AS n, least(h[1] % (len(x) + 1), h[2] % (len(x) + 1)) AS a, greatest(h[1] % (len(x) + 1), h[2] % (len(x) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h[3] % 100 >= $rate THEN 'plain'
WHEN h[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT t, n, form, array_to_string(list_slice(x, 1, a), '') AS p, array_to_string(list_slice(x, a + 1, b), '') AS m, array_to_string(list_slice(x, b + 1, n), '') AS s FROM f)
SELECT n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END AS output FROM p"""
#: Of one part of a long text: how many units it has, and how many code points its first k have.
PART = rf"SELECT len(x) AS n, length(array_to_string(list_slice(x, 1, CAST($k AS BIGINT)), '')) AS at FROM (SELECT regexp_extract_all($t, '{UNIT}') AS x)"
#: Draws and form of a long text of n units that holds no marker.
DRAW = """
WITH h AS (SELECT list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha256($seed || ':' || $id), i, 8) AS BIGINT)) AS h)
SELECT least(h[1] % ($n + 1), h[2] % ($n + 1)), greatest(h[1] % ($n + 1), h[2] % ($n + 1)), CASE WHEN h[3] % 100 >= $rate THEN 'plain' WHEN h[4] % 100 < $spm THEN 'spm' ELSE 'psm' END FROM h"""
#: Bytes of a text beyond which it goes part by part, and code points of a part.
LONG, STEP = 8 << 20, 1 << 21
#: A part may end here: after a word, before white space.
WORD_END = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])")
CUT_ROWS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}

#: The text again, from output and form alone. A marker can't begin inside a text next to one, so its first occurrence is its place.
JOIN = rf"""
WITH o AS (SELECT {TEXT} AS o, {ID} AS form, string_split(substr({TEXT}, 4), CASE {ID} WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END) AS x FROM batch),
r AS (SELECT o, form, x[1] AS one, string_split(x[2], '{MIDDLE}') AS y FROM o)
SELECT CASE form WHEN 'plain' THEN o WHEN 'psm' THEN one || y[2] || y[1] ELSE y[1] || y[2] || one END AS restored FROM r"""

KINDS = {"long": pa.int64(), "string": pa.string()}


def _connection() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": "", "preserve_insertion_order": True})


def cut_long(con: duckdb.DuckDBPyConnection, id: object, text: str, options: dict) -> tuple:
    """CUT's row of one text, whose units are counted part by part."""
    parts, a = [], 0
    while a < len(text):
        end = WORD_END.search(text, a + STEP)
        b = end.end() if end else len(text)
        parts.append((a, b))
        a = b

    def ask(part: tuple[int, int], k: int) -> tuple[int, int]:
        return con.execute(PART, {"t": text[slice(*part)], "k": k}).fetchall()[0]

    sizes = [ask(p, 0)[0] for p in parts]
    n = sum(sizes)

    def place(k: int) -> int:
        for part, size in zip(parts, sizes, strict=True):
            if k <= size:
                return part[0] + ask(part, k)[1]
            k -= size
        return len(text)

    draw = {"seed": options["seed"], "id": "" if id is None else str(id), "n": n, "rate": options["rate"], "spm": options["spm"]}
    one, two, form = con.execute(DRAW, draw).fetchall()[0]
    if form == "plain" or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    i, j = place(one), place(two)
    head = (PREFIX, text[:i], SUFFIX, text[j:]) if form == "psm" else (SUFFIX, text[j:], PREFIX, text[:i])
    return n, form, i, j - i, "".join((*head, MIDDLE, text[i:j]))


def in_duckdb(docs: DataFrame, sql: str, results: dict[str, str], id: str, text: str, options: dict | None = None, long: Callable[..., tuple] | None = None) -> DataFrame:
    """docs with the results of sql over each batch, which is the table batch with ID and TEXT (null: empty) in DuckDB.

    A text of more than LONG bytes goes through long instead, if that is given."""
    kept = [c for c in docs.columns if c not in results]
    own = [F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(kept)]  # their names may be any
    rows = docs.select(*own, F.col(f"`{id}`").alias(ID), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(TEXT))
    schema = docs.select(*own).schema
    for name, kind in results.items():
        schema = schema.add(name, kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for b in K.small(batches, TEXT):
            if long and b.num_rows == 1 and len(data := b.column(TEXT)[0].as_py()) * 4 > LONG and len(data.encode()) > LONG:
                row = long(con, b.column(ID)[0].as_py(), data, options)
                yield pa.record_batch([*b.columns[: len(kept)], *(pa.array([v], KINDS[k]) for v, k in zip(row, results.values(), strict=True))], names=schema.names)
                continue
            con.register("batch", pa.Table.from_batches([b.select([ID, TEXT])]))
            found = con.sql(sql, params=options).to_arrow_table()
            con.unregister("batch")
            yield pa.record_batch([*b.columns[: len(kept)], *(_one(found.column(c), KINDS[k]) for c, k in results.items())], names=schema.names)
        con.close()

    return rows.mapInArrow(scan, schema).toDF(*kept, *results)


def _one(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(column.cast(kind).chunks) if column.num_chunks else pa.array([], kind)


def fill_in_middle(docs: DataFrame, *, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """docs with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    rate: percent of documents that are rearranged, spm: percent of those whose suffix comes first."""
    return in_duckdb(docs, CUT, CUT_ROWS, "doc_id", "text", {"seed": str(seed), "rate": rate, "spm": spm}, long=cut_long)


def restore(rows: DataFrame) -> DataFrame:
    """rows with restored, the text that output and form were made of."""
    return in_duckdb(rows, JOIN, {"restored": "string"}, "form", "output")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = restore(fill_in_middle(docs).drop("text"))
    digests = (F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
