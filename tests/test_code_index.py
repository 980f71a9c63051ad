import pyarrow as pa
from pyspark.sql import functions as F

from contextquarry.operators import code_index
from contextquarry.plans import queries_code


def parsed(spark, files):
    return code_index.parse(spark.createDataFrame(list(files.items()), "file string, content string")).cache()


def test_parsed_files_leave_in_small_batches():
    """A batch of many large files, as Spark hands them over, isn't parsed as one."""
    text = "def f():\n    return [\n" + "        g(),\n" * 5000 + "    ]\n"
    files = pa.RecordBatch.from_pydict({"file": [f"a/m{k}.py" for k in range(40)] + ["a/empty.py"], "content": [text] * 40 + [None]})
    out = list(code_index.parsed_batches(iter([files]), True, ("uses", "froms")))
    assert [x for b in out for x in b.column("file").to_pylist()] == files.column("file").to_pylist()
    assert max(b.num_rows for b in out) * len(text) < 2 * code_index.BATCH + len(text)
    none = next(code_index.parsed_batches(iter([files]), True, ()))
    assert none.column("uses")[0].as_py() == none.column("froms")[0].as_py() == [] and len(none.column("symbols")[0]) == 2


def test_a_name_whose_first_import_is_found_late(spark):
    """m binds f by its first import, whose chain takes longer to follow than the second's; what z imports from m is the same."""
    files = {"p/y.py": "def f(): pass\n", "p/d.py": "def f(): pass\n", "p/b.py": "from .y import f\n", "p/c.py": "from .b import f\n", "p/m.py": "from .c import f\nfrom .d import f\n", "p/z.py": "from .m import f\nf()\n"}
    rows = parsed(spark, files)
    got = {(r["file"], r["name"]): r["at_file"] for r in code_index.exports(rows, code_index.modules(rows)).collect()}
    assert got == {(f, "f"): "p/d.py" if f == "p/d.py" else "p/y.py" for f in files}
    calls = code_index.edges(rows).where("kind = 'call'").collect()
    assert [(r["src"], r["dst"], r["weight"]) for r in calls] == [("p/z.py::<module>", "p/y.py::f", 1)]


def test_uses_are_counted_where_they_stand(spark):
    """One row for a name that a symbol uses often; dotted names go to the longest ancestor that is a symbol; a module of two files counts an import once."""
    files = {
        "p/__init__.py": "",
        "p/a.py": "class C:\n    def m(self): pass\n",
        "p/w/__init__.py": "def g(): pass\n",
        "p/w.py": "def g(): pass\ndef own(): pass\n",
        "p/u.py": "import p.a\nfrom .a import C\nfrom . import a\nfrom .w import g, own\ndef f():\n    C(); C(); C()\n    C.m(); C.m.x(); C.none()\n    p.a.C.m(); q.r()\n    import p.a.C\n",
    }
    rows = parsed(spark, files)
    uses = rows.where("file = 'p/u.py'").select(F.explode("uses").alias("u")).select("u.*").collect()
    assert [r["n"] for r in uses if r["name"] == "C" and r["kind"] == "call"] == [6]  # its attributes name it, too
    edges = code_index.edges(rows)
    got = sorted((r["src"].split("::")[1], r["dst"], r["kind"], r["weight"]) for r in edges.collect() if r["dst"].startswith(("p/a", "p/w")))
    assert [x for x in got if x[1].startswith("p/a")] == [
        ("<module>", "p/a.py::<module>", "import", 2),
        ("<module>", "p/a.py::C", "import", 1),
        ("f", "p/a.py::<module>", "call", 1),
        ("f", "p/a.py::C", "call", 8),
        ("f", "p/a.py::C", "import", 1),
        ("f", "p/a.py::C.m", "call", 4),
    ]
    assert [x[1:] for x in got if x[1].startswith("p/w")] == [("p/w.py::own", "import", 1), ("p/w/__init__.py::g", "import", 1)]
    # without p/__init__.py, what is imported from p itself is unknown
    rows = parsed(spark, {f: c for f, c in files.items() if f != "p/__init__.py"})
    assert code_index.edges(rows).where("src = 'p/u.py::<module>' AND dst = 'p/a.py::<module>'").select("weight").collect()[0][0] == 1


def test_sample_edges_are_planned_in_steps(spark, sf):
    """Sources are parsed by all cores, and the last plan has few shuffles: the driver holds each of its states."""
    assert queries_code.shops(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = queries_code.sample_edges(spark, sf)._jdf.queryExecution().toString()
    assert plan.count("Exchange") < 40 and len(plan) < 60_000
