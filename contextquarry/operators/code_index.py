"""From source files to symbols and weighted references.

Each file is parsed inside a task, by the standard library's ast; what it says of other files is resolved by joins.
"""

from __future__ import annotations

import ast
import itertools
import os
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contextquarry.operators.graph import collapse
from contextquarry.scratch import materialize

MODULE = "<module>"
#: hash: what tells a symbol's id from those of its namesakes in the file, empty without one; last: whether it is the last of them, which edges go to.
SYMBOL = "ord long, kind string, name string, qualname string, hash string, last boolean, line_start long, line_end long, signature string, doc_first string, doc_rest string, body string"
#: Folders beside a project's package.
BESIDE = ("tests", "test", "docs", "examples", "scripts")
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: A plain reference: the symbol with the id src uses a dotted name n times.
USE = "src string, kind string, name string, n long"
#: A name of a from-import. rel: levels of a relative one; alias: what it binds in the module, null for nothing; at: its place in the file; src: the symbol that it is a reference of, null for none.
FROM = "name string, module string, rel long, alias string, at long, src string"
PARSED = ", ".join(f"{n} array<struct<{', '.join(x.replace(' ', ':') for x in ddl.split(', '))}>>" for n, ddl in (("symbols", SYMBOL), ("uses", USE), ("froms", FROM))) + ", error string"
#: Characters of source, and 200 a file, that a batch of parsed files has about: what a task holds doesn't grow with its files.
BATCH = 1 << 18


def scan(spark: SparkSession, root: str) -> DataFrame:
    """file (relative to the parent of root) and content of a package's .py files, in order, without folders whose name begins with a dot.

    Spark's own readers pass over names that begin with an underscore, so the driver lists the names and tasks read the files: root must be a folder that all can
    see. A corpus of many packages is better kept as a table of (file, content), which is all that parse() needs.
    """
    base, names = os.path.dirname(root.rstrip("/")), []
    for folder, below, files in os.walk(root):
        below[:] = [x for x in below if not x.startswith(".")]
        names += [os.path.relpath(os.path.join(folder, x), base) for x in files if x.endswith(".py")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("file").to_pylist()
            texts = [Path(base, x).read_text(encoding="utf-8") for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(texts, pa.string())], names=["file", "content"])

    return spark.createDataFrame([(x,) for x in sorted(names)], "file string").repartition("file").mapInArrow(read, "file string, content string")


def package_root(root: str) -> str:
    """root itself if it is a package, else the one package below it that isn't one of BESIDE or hidden."""
    if os.path.isfile(os.path.join(root, "__init__.py")):
        return root
    found = [x for x in sorted(os.listdir(root)) if os.path.isfile(os.path.join(root, x, "__init__.py")) and not x.startswith(".") and x not in BESIDE]
    if len(found) != 1:
        raise ValueError(f"{len(found)} packages below {root}")
    return os.path.join(root, found[0])


@dataclass(frozen=True)
class Definition:
    """A symbol before its texts: what it is called, the node, and its body's spans of bytes; head is the span of its signature."""

    kind: str
    name: str
    qualname: str
    node: ast.AST
    first_line: int
    last_line: int
    head: tuple[int, int] = (0, 0)
    body: tuple[tuple[int, int], ...] = ()


class Source:
    """A file's bytes and its tree. Places of the tree (line, column in bytes) become offsets, so every text is one slice."""

    def __init__(self, file: str, content: str):
        self.file, self.raw, self.tree = file, content.encode("utf-8", "surrogatepass"), ast.parse(content)
        self.line_at = [0, *(m.end() for m in re.finditer(rb"\r\n?|\n", self.raw))]

    def start(self, node: ast.AST) -> int:
        return self.line_at[node.lineno - 1] + node.col_offset

    def end(self, node: ast.AST) -> int:
        return self.line_at[node.end_lineno - 1] + node.end_col_offset

    def text(self, span: tuple[int, int]) -> str:
        return self.raw[span[0] : span[1]].decode("utf-8", "replace")

    def definitions(self) -> Iterator[Definition]:
        """The module, its functions and classes, and each class's own methods; what stands under a condition is none."""
        path = self.file.removesuffix(".py").split("/")
        name = path[-2] if path[-1] == "__init__" else path[-1]
        yield Definition("module", name, MODULE, self.tree, 1, len(self.line_at))
        for node in self.tree.body:
            if isinstance(node, FUNCTIONS):
                yield self._function("func", node.name, node)
            elif isinstance(node, ast.ClassDef):
                plain = (x for x in node.body if not isinstance(x, FUNCTIONS) and not _is_text(x))
                yield Definition("class", node.name, node.name, node, node.lineno, node.end_lineno, self._head(node), tuple((self.start(x), self.end(x)) for x in plain))
                for x in filter(lambda x: isinstance(x, FUNCTIONS), node.body):
                    yield self._function("method", f"{node.name}.{x.name}", x)

    def _head(self, node) -> tuple[int, int]:
        return self.start(node), self.start(node.body[0])

    def _function(self, kind: str, qualname: str, node) -> Definition:
        documented = ast.get_docstring(node, clean=False) is not None
        begin = self.end(node.body[0]) if documented else self.start(node.body[0])
        return Definition(kind, node.name, qualname, node, node.lineno, node.end_lineno, self._head(node), ((begin, self.end(node)),))

    def symbols(self) -> list[tuple]:
        """Values of SYMBOL."""
        out, found = [], list(self.definitions())
        same, last = Counter(d.qualname for d in found), {d.qualname: at for at, d in enumerate(found)}
        for at, d in enumerate(found):
            doc = list(itertools.dropwhile(lambda x: not x.strip(), (ast.get_docstring(d.node, clean=True) or "").split("\n")))
            bodies = [self.text(x) for x in d.body]
            if d.kind == "class":
                bodies = [x for x in bodies if x.strip()]
            hashed = f"#{d.first_line}" if same[d.qualname] > 1 else ""
            out.append((at, d.kind, d.name, d.qualname, hashed, last[d.qualname] == at, d.first_line, d.last_line, self.text(d.head).strip(), "".join(doc[:1]), "\n".join(doc[1:]), "\n\n".join(bodies)))
        return out

    def uses(self, ids: dict[str, str]) -> list[tuple]:
        """Values of USE. ids: the symbol that references of a qualified name belong to."""
        out: Counter[tuple[str, str, str]] = Counter()

        def named(owner: str, kind: str, nodes) -> None:
            for node in nodes:
                names = {node.id} if isinstance(node, ast.Name) else {ast.unparse(n) for n in ast.walk(node) if isinstance(n, ast.Name | ast.Attribute)}
                out.update((ids[owner], kind, name) for name in names)

        for d in self.definitions():
            node, statements = d.node, d.node.body
            if d.kind != "module":
                named(d.qualname, "decorator", node.decorator_list)
            if d.kind == "class":
                named(d.qualname, "inheritance", node.bases)
            elif d.kind != "module":
                given = [x.annotation for x in ast.walk(node.args) if isinstance(x, ast.arg)]
                named(d.qualname, "annotation", [x for x in (node.returns, *given) if x is not None])
            for x in statements:
                match x:
                    case ast.Import():
                        out.update((ids[d.qualname], "import", a.name) for a in x.names)
                    case ast.ImportFrom() | ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                        pass
                    case _:
                        named(d.qualname, "call", (n.func for n in ast.walk(x) if isinstance(n, ast.Call)))
        return [(*key, n) for key, n in out.items()]

    def froms(self, ids: dict[str, str]) -> list[tuple]:
        """Values of FROM, wherever they stand, in the order of the tree's levels; references are those that stand in a symbol itself."""
        owners = {x: ids[d.qualname] for d in self.definitions() for x in d.node.body if isinstance(x, ast.ImportFrom)}
        out, level = [], deque([self.tree])
        while level:
            x = level.popleft()
            if isinstance(x, ast.ImportFrom):
                out += [(a.name, x.module or "", x.level, None if x.module == "__future__" else a.asname or a.name, len(out) + k, owners.get(x)) for k, a in enumerate(x.names)]
            else:  # expressions hold no statements
                level.extend(n for n in ast.iter_child_nodes(x) if not isinstance(n, ast.expr))
        return out

    def parsed(self, refs: tuple[str, ...]) -> tuple[list[tuple], list[tuple], list[tuple]]:
        symbols = self.symbols()
        ids = {x[3]: f"{self.file}::{x[3]}{x[4]}" for x in symbols}  # the last of a collision
        return symbols, self.uses(ids) if "uses" in refs else [], self.froms(ids) if "froms" in refs else []


def _is_text(x: ast.stmt) -> bool:
    return isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str)


def parsed_batches(batches: Iterator[pa.RecordBatch], strict: bool, refs: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of parsed files, of about BATCH each or of one file."""
    rows, held = [], 0
    for batch in batches:
        for file, content in zip(batch.column("file"), batch.column("content"), strict=True):
            file, content = file.as_py(), content.as_py() or ""
            try:
                rows.append((file, *Source(file, content).parsed(refs), None))
            except (SyntaxError, ValueError) as e:
                if strict:
                    raise ValueError(f"{file} doesn't parse: {e}") from e
                rows.append((file, [], [], [], str(e)))
            held += len(content) + 200
            if held >= BATCH:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def parse(files: DataFrame, strict: bool = True, refs: tuple[str, ...] = ("uses", "froms")) -> DataFrame:
    """file, symbols, uses, froms and error for rows (file, content). refs: which references are wanted; symbols() needs none, exports() froms, and edges() both.

    A file that doesn't parse ends the job with its name. With strict=False it has no symbols and says why in error: then read that column.
    """

    return files.mapInArrow(lambda batches: parsed_batches(batches, strict, refs), f"file string, {PARSED}")


def _arrow(ddl: str) -> pa.DataType:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    return pa.list_(pa.struct([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))]))


_SCHEMA = pa.schema([("file", pa.string()), ("symbols", _arrow(SYMBOL)), ("uses", _arrow(USE)), ("froms", _arrow(FROM)), ("error", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of _SCHEMA, column by column: with a dict for each reference, a batch took many times the memory and time."""

    def lists(own: tuple[list[tuple], ...], kind: pa.DataType) -> pa.Array:
        fields = list(kind.value_type)
        values = list(zip(*itertools.chain.from_iterable(own), strict=True)) or [()] * len(fields)
        structs = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], fields=fields)
        return pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(map(len, own))], pa.int32()), structs, type=kind)

    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([lists(c, f.type) if pa.types.is_list(f.type) else pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _id(file: str, qualname: str, hashed: str) -> Column:
    return F.concat(file, F.lit("::"), qualname, hashed)


def symbols(parsed: DataFrame) -> DataFrame:
    """All symbols with id: file::qualname, and #line for every member of a collision."""
    return parsed.select("file", F.explode("symbols").alias("s")).select("file", "s.*").withColumn("id", _id("file", "qualname", "hash")).drop("hash", "last")


def outline(parsed: DataFrame) -> DataFrame:
    """parsed without the texts of symbols, which exports() and edges() don't read."""
    return parsed.withColumn("symbols", F.transform("symbols", lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "name", "qualname", "hash", "last")))))


def _module(file: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file, r"(/__init__)?\.py$", ""), "/", ".")


def _package(file: Column) -> Column:
    dotted = _module(file)
    return F.when(file.endswith("__init__.py") | ~dotted.contains("."), dotted).otherwise(F.regexp_replace(dotted, r"\.[^.]+$", ""))


def modules(parsed: DataFrame) -> DataFrame:
    """file, module (its dotted name) and package (that of relative imports)."""
    return parsed.select("file", _module(F.col("file")).alias("module"), _package(F.col("file")).alias("package"))


def _froms(parsed: DataFrame) -> DataFrame:
    """file, name, alias, at, src and to (the module) of from-imports; those that leave the package go."""
    rows = parsed.withColumn("package", _package(F.col("file"))).select("file", "package", F.explode("froms").alias("r")).select("file", "package", "r.*")
    parts = F.split("package", r"\.")
    base = F.slice(parts, 1, F.greatest(F.size(parts) - F.greatest(F.col("rel") - 1, F.lit(0)), F.lit(0)).cast("int"))
    to = F.when(F.col("rel") == 0, F.col("module")).when(F.col("rel") - 1 < F.size(parts), F.concat_ws(".", base, F.nullif("module", F.lit(""))))
    return rows.select("file", "name", "alias", "at", "src", to.alias("to")).where("to IS NOT NULL")


_BOUND = ["file", "name", "turn", "at", "at_file", "at_name", "hash"]


def _found(froms: DataFrame, known: DataFrame) -> DataFrame:
    """What from-imports find among known names: file, name (in the file, null if it isn't bound: a star refers to names that begin with an underscore, too, but doesn't bind them), turn, at, at_file, at_name, hash, src,
    star (whether it is a star's) and sole (whether it is of the last file of its module that has the name: a package goes before a module of its name). Imports of single names that find none have a row without at_file, but with to, the module that would be meant."""
    of = known.select(_module(F.col("file")).alias("_to"), F.col("name").alias("_name"), F.col("file").alias("to_file"), F.col("turn").alias("_turn"), F.col("at").alias("_at"), "at_file", "at_name", "hash")
    of = of.withColumn("sole", F.row_number().over(Window.partitionBy("_to", "_name").orderBy(F.desc("to_file"))) == 1)
    named = froms.where("name <> '*'").join(of, (F.col("to") == F.col("_to")) & (F.col("name") == F.col("_name")), "left").withColumn("to", F.when(F.col("at_file").isNull(), F.concat_ws(".", "to", "name")))
    star = froms.where("name = '*'").join(of, F.col("to") == F.col("_to")).withColumn("alias", F.expr("CASE WHEN alias IS NOT NULL AND NOT startswith(_name, '_') THEN _name END")).withColumn("to", F.lit(None).cast("string"))
    later = (F.col("_turn") == 0) | (F.col("file") < F.col("to_file")) | ((F.col("file") == F.col("to_file")) & (F.col("at") <= F.col("_at")))
    rows = named.withColumn("star", F.lit(False)).unionByName(star.withColumn("star", F.lit(True)))
    return rows.select("file", F.col("alias").alias("name"), (F.col("_turn") + later.cast("long")).alias("turn"), "at", "at_file", "at_name", "hash", "src", "star", "sole", "to")


def _least(rows: DataFrame) -> DataFrame:
    """The least moment of each name of each file."""
    return rows.groupBy("file", "name").agg(F.min(F.struct(*_BOUND[2:])).alias("x")).select("file", "name", "x.*")


def _known(parsed: DataFrame, index: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The definitions, and with them what names mean in modules that others import from: columns _BOUND, as exports() has it.

    Only these take part in the rounds; what the names of others mean follows from theirs at once.
    """
    own = parsed.select("file", F.explode("symbols").alias("s")).where("s.last AND s.kind IN ('func', 'class')")
    own = materialize(own.select("file", F.col("s.name").alias("name"), F.lit(0).cast("long").alias("turn"), F.lit(-1).cast("long").alias("at"), F.col("file").alias("at_file"), F.col("s.qualname").alias("at_name"), F.col("s.hash").alias("hash")), "definitions")
    asked = _froms(parsed).where("alias IS NOT NULL").select("to").distinct()
    binding = parsed.where(F.exists("froms", lambda x: x["alias"].isNotNull())).select("file")
    inner = materialize(binding.join(index, "file").join(asked, F.col("module") == F.col("to"), "left_semi").select("file"), "asked-files", free=True)
    if inner.isEmpty():
        return own, own
    binds = materialize(_froms(parsed.join(inner, "file", "left_semi")).where("alias IS NOT NULL"), "binds", free=True)
    known = own
    for _ in range(rounds):
        found = _found(binds, known).where("name IS NOT NULL AND at_file IS NOT NULL").select(*_BOUND)
        least = materialize(_least(own.unionByName(found)), "exports", free=True)
        if not least.join(known, _BOUND, "left_anti").take(1):
            return own, least
        known = least
    raise RuntimeError(f"exports still change after {rounds} rounds")


def exports(parsed: DataFrame, index: DataFrame, rounds: int = 1000) -> DataFrame:
    """file, name, at_file, at_name: what a name means in a module. index: the modules of parsed.

    Definitions win, the last one of a name; then the import that binds the name first when files are gone through in order, round after round, until nothing is bound:
    an import binds in the round in which its target has the name, or in the next if the target got it later in the same
    round. That moment is (turn, file, place), so what is sought is the least moment of each name: moments are found anew by joins, from those of the round before, until none changes.
    """
    own, known = _known(parsed, index, rounds)
    found = _found(_froms(parsed).where("alias IS NOT NULL"), known).where("name IS NOT NULL AND at_file IS NOT NULL").select(*_BOUND)
    return _least(own.unionByName(found).repartition("file")).select("file", "name", "at_file", "at_name")


def _prefixes(name: Column) -> Column:
    """The dotted prefixes of a name, with the rest: array of (prefix, rest, length)."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), ".").alias("prefix"), F.array_join(F.slice(parts, k + 1, F.size(parts)), ".").alias("rest"), k.alias("k")))


def _ancestors(rows: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """key and dst, the longest ancestor of the qualified name at_name in at_file that is a symbol; rows without one go. Rows differ in key."""
    tries = rows.select(*key, "at_file", F.explode(_prefixes(F.col("at_name"))).alias("p")).select(*key, "at_file", F.col("p.prefix").alias("qualname"), "p.k")
    return tries.join(ids, ["at_file", "qualname"]).groupBy(*key).agg(F.max_by("dst", "k").alias("dst"))


def edges(parsed: DataFrame, rounds: int = 1000) -> DataFrame:
    """Collapsed edges between symbol ids: repo, src, dst, kind, weight.

    Rows of one use or import each go by their file once, to meet what names mean there; the few that say more than one name, or name modules, are looked up apart. Each step is
    written, so shuffle files go with it.
    """
    index = modules(parsed)
    ids = parsed.select("file", F.explode("symbols").alias("s")).where("s.last").select(F.col("file").alias("at_file"), F.col("s.qualname").alias("qualname"), _id("file", "s.qualname", "s.hash").alias("dst"))
    own, known = _known(parsed, index, rounds)
    found = materialize(_found(_froms(parsed), known), "imports", free=True)
    main = index.groupBy("module").agg(F.max("file").alias("at_file"))

    # names that begin with a module's, wherever they are used
    uses = parsed.select(F.col("file"), F.explode("uses").alias("r")).select("file", "r.*")
    cut = uses.select("name").distinct().select("name", F.explode(_prefixes(F.col("name"))).alias("p")).select("name", "p.*").join(main, F.col("prefix") == F.col("module"))
    cut = cut.groupBy("name").agg(F.max(F.struct("k", "at_file", "rest")).alias("x")).select("name", "x.at_file", F.when(F.col("x.rest") == "", MODULE).otherwise(F.col("x.rest")).alias("at_name"))
    inside = materialize(cut, "module-names", free=True)
    inside = materialize(inside.join(_ancestors(inside, ids, ["name"]), "name", "left").select("name", "dst"), "module-uses", free=True)

    # other names, by what their first part means in the file
    outside = uses.where("kind <> 'import'").join(inside.select("name"), "name", "left_anti").select("file", F.split_part("name", F.lit("."), F.lit(1)).alias("first"), F.struct("src", "kind", "name", "n").alias("u"))
    means = own.unionByName(found.where("name IS NOT NULL AND at_file IS NOT NULL").select(*_BOUND)).select("file", F.col("name").alias("first"), F.struct(*_BOUND[2:]).alias("x"))
    by = means.unionByName(outside, allowMissingColumns=True).repartition("file").groupBy("file", "first").agg(F.min("x").alias("x"), F.collect_list("u").alias("u"))
    by = by.where("x IS NOT NULL").select(F.explode("u").alias("u"), "x.at_file", "x.at_name", "x.hash").select("u.*", "at_file", "at_name", "hash")
    by = materialize(by, "named-uses", free=True)
    dotted = by.where(F.contains("name", F.lit("."))).withColumn("at_name", F.concat_ws(".", "at_name", F.regexp_replace("name", r"^[^.]*\.", "")))

    single = found.where("src IS NOT NULL AND NOT star")
    ends = [
        by.where(~F.contains("name", F.lit("."))).select("src", "kind", "n", _id("at_file", "at_name", "hash").alias("dst")),
        _ancestors(dotted, ids, ["src", "kind", "name", "n"]).drop("name"),
        uses.join(inside, "name").where("dst IS NOT NULL").select("src", "kind", "n", "dst"),
        single.where("sole").select("src", F.lit("import").alias("kind"), F.lit(1).cast("long").alias("n"), _id("at_file", "at_name", "hash").alias("dst")),
        single.where("at_file IS NULL").drop("at_file").join(main.select(F.col("module").alias("above")), F.regexp_replace("to", r"\.[^.]*$", "") == F.col("above"), "left_semi").join(main, F.col("to") == F.col("module")).select("src", F.lit("import").alias("kind"), F.lit(1).cast("long").alias("n"), F.concat("at_file", F.lit(f"::{MODULE}")).alias("dst")),
        found.where("src IS NOT NULL AND star").select("src", F.lit("import").alias("kind"), F.lit(1).cast("long").alias("n"), "at", _id("at_file", "at_name", "hash").alias("dst")).distinct().drop("at"),
    ]
    return collapse(reduce(DataFrame.unionByName, ends).select(F.lit("code").alias("repo"), "src", "dst", "kind", "n"), "n")
