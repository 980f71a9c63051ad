"""Queries of the code index, over packages whose sources Spark derives from the given tables: one like the literal sample for each supplier, and one of all that was ordered."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from contextquarry.catalog import query
from contextquarry.functions.text import estimate_sql, with_costs
from contextquarry.operators import code_index
from contextquarry.plans import sample_package
from contextquarry.scratch import materialize, scratch
from contextquarry.session import spread
from contextquarry.sources import tables as T

#: Bytes of a block of parsed files.
BLOCK = 8 << 20

# what was ordered: a module with a class for each part, and one for each supplier, which imports its parts and calls them once for each order line


def market(spark, d):
    """file, content: the sources of the package `market`. Lines are shuffled once, as numbers, by the module that they go to."""
    parts = spread(T.table(spark, d, "part")).select(
        F.format_string("market/parts/p%d.py", "p_partkey").alias("file"), F.concat(F.lit("class P"), F.col("p_partkey").cast("string"), F.lit(':\n    """'), F.col("p_name"), F.lit('"""\n')).alias("content")
    )
    lines = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).repartition("s").groupBy("s", "p").agg(F.count(F.lit(1)).cast("int").alias("n"))
    own = lines.groupBy("s").agg(F.sort_array(F.collect_list(F.struct(F.col("p").cast("string").alias("p"), "n"))).alias("x"))
    imports = lambda x: F.concat(F.lit("from market.parts.p"), x["p"], F.lit(" import P"), x["p"], F.lit("\n"))
    calls = lambda x: F.repeat(F.concat(F.lit("        P"), x["p"], F.lit("(),\n")), x["n"])
    joined = lambda f: F.array_join(F.transform("x", f), "")
    content = F.concat(F.lit("from __future__ import annotations\n"), joined(imports), F.lit("def supply():\n    return [\n"), joined(calls), F.lit("    ]\n"))
    return parts.unionByName(own.select(F.format_string("market/suppliers/s%d.py", "s").alias("file"), content.alias("content")))


_MARKET = """
lines AS (SELECT l_suppkey AS s, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY ALL),
sellers AS (SELECT s, count(*) AS kinds, sum(n)::BIGINT AS n, sum(n * (length(p::VARCHAR) + 13))::BIGINT AS chars FROM lines GROUP BY s),
names AS (SELECT s, 'market/suppliers/s' || s || '.py' AS file, kinds, n, chars FROM sellers)"""


def _parsed(files, *refs):
    """What exports() and edges() read of files, written in small blocks: a reader holds the references of all files of a block."""
    return materialize(code_index.outline(code_index.parse(files, refs=refs)), "parsed", free=True, block=BLOCK)


@query(
    "code_symbols",
    f"""WITH {_MARKET}, found AS (
      SELECT 'market/parts/p' || p_partkey || '.py' AS file, 'module' AS kind, 'p' || p_partkey AS name, '<module>' AS qualname, 1 AS line_start, 3 AS line_end, chr(10) || chr(10) AS shown FROM part
      UNION ALL SELECT 'market/parts/p' || p_partkey || '.py', 'class', 'P' || p_partkey, 'P' || p_partkey, 1, 2, 'class P' || p_partkey || ':' || chr(10) || p_name || chr(10) || chr(10) FROM part
      UNION ALL SELECT file, 'module', 's' || s, '<module>', 1, kinds + n + 5, chr(10) || chr(10) FROM names
      UNION ALL SELECT file, 'func', 'supply', 'supply', kinds + 2, kinds + n + 4, repeat('x', 13 + 1 + 9 + chars + 5 + 2) FROM names)
    SELECT file || '::' || qualname AS id, file, kind, name, qualname, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, {estimate_sql('shown')} AS full_tokens FROM found""",
)
def code_symbols(spark, d):
    rows = with_costs(code_index.symbols(code_index.parse(market(spark, d), refs=())))
    return rows.select("id", "file", "kind", "name", "qualname", "line_start", "line_end", F.col("tokens.full").alias("full_tokens"))


@query(
    "code_exports",
    f"""WITH {_MARKET} SELECT 'market/parts/p' || p_partkey || '.py' AS file, 'P' || p_partkey AS name, 'market/parts/p' || p_partkey || '.py' AS at_file, 'P' || p_partkey AS at_name FROM part
    UNION ALL SELECT file, 'supply', file, 'supply' FROM names
    UNION ALL SELECT n.file, 'P' || p, 'market/parts/p' || p || '.py', 'P' || p FROM lines l JOIN names n ON n.s = l.s JOIN part x ON x.p_partkey = l.p""",
)
def code_exports(spark, d):
    parsed = _parsed(market(spark, d), "froms")
    return code_index.exports(parsed, code_index.modules(parsed))


@query(
    "code_edges",
    f"""WITH {_MARKET}, e AS (SELECT n.file, 'market/parts/p' || p || '.py::P' || p AS dst, l.n FROM lines l JOIN names n ON n.s = l.s JOIN part x ON x.p_partkey = l.p)
    SELECT 'code' AS repo, file || '::<module>' AS src, dst, 'import' AS kind, 1 AS weight FROM e UNION ALL SELECT 'code', file || '::supply', dst, 'call', n FROM e""",
)
def code_edges(spark, d):
    return code_index.edges(_parsed(market(spark, d), "uses", "froms"))


# the literal sample, once for each supplier: all that it has to show, in as many packages as there are suppliers

_SAYS = "Things for sale."


def shops(spark, d):
    """file, content: the sample for each supplier, as the package shop<key>, with the supplier's name in a docstring."""
    files = spark.createDataFrame(list(sample_package.FILES.items()), "file string, content string")
    suppliers = spread(T.table(spark, d, "supplier")).select(F.concat(F.lit("shop"), F.col("s_suppkey").cast("string")).alias("shop"), "s_name")
    rows = suppliers.crossJoin(F.broadcast(files))  # as many rows as the sample has files
    content = F.replace(F.replace("content", F.lit("shop."), F.concat("shop", F.lit("."))), F.lit(_SAYS), F.concat(F.lit("Things of "), "s_name"))
    return rows.select(F.concat("shop", F.substr("file", F.lit(5))).alias("file"), content.alias("content"))


def _values(rows, names: str) -> str:
    """What the sample has to show, for each supplier. Paths begin with shop/, and stand for those of the supplier's package."""
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    shop = lambda c: f"CASE WHEN starts_with(t.{c}, 'shop/') THEN 'shop' || s_suppkey || t.{c}[5:] WHEN t.{c} = '{_SAYS}' THEN 'Things of ' || s_name ELSE t.{c} END AS {c}"
    columns = [c if isinstance(v, int) else shop(c) for c, v in zip(names.split(", "), rows[0], strict=True)]
    return f"SELECT {', '.join(columns)} FROM supplier, (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


@query("sample_symbols", _values(sample_package.SYMBOLS, "id, kind, line_start, line_end, signature, doc_first, doc_rest, body"))
def sample_symbols(spark, d):
    return code_index.symbols(code_index.parse(shops(spark, d), refs=())).select("id", "kind", "line_start", "line_end", "signature", "doc_first", "doc_rest", "body")


@query("sample_exports", _values(sample_package.EXPORTS, "file, name, at_file, at_name"))
def sample_exports(spark, d):
    parsed = _parsed(shops(spark, d), "froms")
    return code_index.exports(parsed, code_index.modules(parsed))


@query("sample_edges", _values(sample_package.EDGES, "src, dst, kind, weight"))
def sample_edges(spark, d):
    return code_index.edges(_parsed(shops(spark, d), "uses", "froms")).select("src", "dst", "kind", "weight")


def write_files(files, root: str) -> None:
    """Write files (file, content) below a folder that all workers share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = Path(root, file)
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(content, encoding="utf-8")
            yield pa.RecordBatch.from_arrays([batch.column("file")], names=["file"])

    files.mapInArrow(run, "file string").count()


_FILES = ", ".join(f"('{f}', '{c.replace(chr(39), chr(39) * 2)}')" for f, c in sample_package.FILES.items())


@query(
    "src_scan",
    f"""SELECT 'shops/shop' || s_suppkey || t.file[5:] AS file, sha256(replace(replace(t.content, 'shop.', 'shop' || s_suppkey || '.'), '{_SAYS}', 'Things of ' || s_name)) AS content_sha256 FROM supplier, (VALUES {_FILES}) t(file, content)
    UNION ALL SELECT 'shops/__init__.py', sha256('')""",
)
def src_scan(spark, d):
    """The files of a project's package, found below the project's folder beside its tests and hidden folders."""
    root = f"{scratch(spark).removeprefix('file://')}/project-{uuid.uuid4().hex[:12]}"
    own = shops(spark, d).select(F.concat(F.lit("shops/"), "file").alias("file"), "content")
    more = [(f, "") for f in ("shops/__init__.py", "shops/.cache/x.py", "shops/notes.txt", "test/__init__.py", "docs/__init__.py", ".venv/__init__.py", "setup.py")]
    write_files(own.unionByName(spark.createDataFrame(more, "file string, content string")), root)
    return code_index.scan(spark, code_index.package_root(root)).select("file", F.sha2("content", 256).alias("content_sha256"))
