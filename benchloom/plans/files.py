"""Queries that write files of the supported kinds and read them back through the library's readers."""

from __future__ import annotations

import io
import sqlite3
import tempfile
import uuid
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.operators import grids
from benchloom.plans.recordings import REC, recording
from benchloom.registry import query
from benchloom.sources import delimited, files, loader, roles, sqlite, xls
from benchloom.sources.profiles import detect
from benchloom.sources.shipped import SHIPPED


def _place(spark, name: str) -> str:
    """A fresh path in the session's shared folder; a local one only in local mode, where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names the folder that executors share; it is not set")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}-{name}"


def _lines(spark, parts, name: str) -> str:
    """Lines (at, value) in order, as a folder whose files are one text in the order of their names; each task writes its own."""
    path = _place(spark, name)
    parts.orderBy("at").select("value").write.text(path)
    return path


def _export(spark, d) -> str:
    k = F.col("o_orderkey")
    price = F.when(k % 50 == 0, "ERR").when(k % 50 == 1, "12f").otherwise(F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")))
    row = F.concat_ws(";", F.concat(k.cast("string"), F.lit(",5")), price, F.when(k % 7 > 0, F.col("o_orderstatus")).otherwise(" "), F.col("o_custkey").cast("string"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("at"), row.alias("value"))
    head = spark.createDataFrame([(-2, "# export 7"), (-1, "Time;Preis [EUR];Status;Kunden ID"), (2**40, "// end of data"), (2**40 + 1, ";;;")], "at long, value string")
    return _lines(spark, rows.unionByName(head), "orders.csv")


@query("load_delimited", "SELECT o_orderkey + 0.5 AS time_seconds, CASE WHEN o_orderkey % 50 > 1 THEN o_totalprice END AS preis, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS status, o_custkey AS kunden_id FROM orders")
def load_delimited(spark, d):
    return delimited.load(spark, _export(spark, d)).df.drop("row_index")


@query("load_audit", "SELECT row_number() OVER (ORDER BY o_orderkey) + 1 AS row_index, 'preis' AS \"column\", CASE WHEN o_orderkey % 50 = 0 THEN 'ERR' ELSE '12f' END AS raw_value, CASE WHEN o_orderkey % 50 = 0 THEN 'sentinel_value' ELSE 'non_convertible_float' END AS reason FROM orders QUALIFY o_orderkey % 50 < 2")
def load_audit(spark, d):
    """Row indices are lines of the file, counted from 0."""
    return delimited.load(spark, _export(spark, d)).audit


@query("load_quoted", """SELECT CAST(o_orderkey AS DOUBLE) AS time_seconds, CASE WHEN o_orderkey % 4999 = 4000 THEN o_orderpriority || chr(10) || '#;' || chr(10) || chr(10) || 'say ''"x"''' ELSE o_orderpriority END AS name, CAST(o_custkey AS DOUBLE) AS customer FROM orders""")
def load_quoted(spark, d):
    """Cells that hold line ends, delimiters and quotes, the first of them thousands of lines from the file's head."""
    k = F.col("o_orderkey")
    name = F.when(k % 4999 == 4000, F.concat(F.lit('"'), "o_orderpriority", F.lit("\n#;\n\nsay '\"\"x\"\"'\""))).otherwise(F.col("o_orderpriority"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("at"), F.concat_ws(";", k.cast("string"), name, F.col("o_custkey").cast("string")).alias("value"))
    head = spark.createDataFrame([(-1, "time;name;customer")], "at long, value string")
    return delimited.load(spark, _lines(spark, rows.unionByName(head), "quoted.csv")).df.drop("row_index")


def _database(spark, d) -> str:
    """Nations, regions and customers in a file of a database; customers come to it one by one."""
    nations, regions = (spark.read.parquet(f"{d}/{t}.parquet").collect() for t in ("nation", "region"))  # 25 and 5 rows
    with tempfile.NamedTemporaryFile(suffix=".db") as f:
        con = sqlite3.connect(f.name)
        con.execute("CREATE TABLE nation (id INTEGER, name TEXT, region INTEGER)")
        con.execute("CREATE TABLE region (id INTEGER, name TEXT)")
        con.execute("CREATE TABLE customer (id INTEGER PRIMARY KEY, name TEXT, nation INTEGER, balance, segment TEXT)")
        con.executemany("INSERT INTO nation VALUES (?, ?, ?)", [(r.n_nationkey, r.n_name, r.n_regionkey) for r in nations])
        con.executemany("INSERT INTO region VALUES (?, ?)", [(r.r_regionkey, r.r_name) for r in regions])
        customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        con.executemany("INSERT INTO customer VALUES (?, ?, ?, ?, ?)", (tuple(r) for r in customers.toLocalIterator()))
        con.commit()
        con.close()
        f.seek(0)
        return files.put_bytes(spark, _place(spark, "places.db"), f.read())


@query("load_sqlite", "SELECT c_custkey AS id, c_name AS name, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def load_sqlite(spark, d):
    """A join of three tables inside the database."""
    return sqlite.read(spark, _database(spark, d), sql="SELECT c.id, c.name, n.name AS nation, r.name AS region FROM customer c JOIN nation n ON n.id = c.nation JOIN region r ON r.id = n.region")


@query("sqlite_ranges", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 > 0")
def sqlite_ranges(spark, d):
    """A table by ranges of row ids, a condition applied inside the database, rows numbered over all ranges."""
    return sqlite.read(spark, _database(spark, d), "customer", where="id % 3 > 0", numbered="row_index", split_rows=400)


@query("sqlite_tables", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def sqlite_tables(spark, d):
    """The tables of a database and how many rows each has."""
    path = _database(spark, d)
    counts = [sqlite.read(spark, path, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in files.table_names(spark, path)]
    return reduce(DataFrame.unionByName, counts)


def _workbook(spark, d) -> str:
    rows = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
    grid = [["Journal", "7"], [], ["Nr", "Name", "Region [id]"], *[[str(r.n_nationkey), r.n_name, str(r.n_regionkey)] for r in rows]]
    cell = lambda i, j, v: f'<c r="{files.column_letters(j + 1)}{i + 1}"' + (f"><v>{v}</v></c>" if v.isdigit() else f' t="inlineStr"><is><t>{v}</t></is></c>')
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(grid)) + "</sheetData></worksheet>"
    book = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Tag" sheetId="1" r:id="rId1"/></sheets></workbook>'
    links = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="x" Target="worksheets/sheet1.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", links), ("xl/worksheets/sheet1.xml", sheet)):
            z.writestr(name, text)
    return files.put_bytes(spark, _place(spark, "journal.xlsx"), out.getvalue())


@query("load_excel", "SELECT CAST(n_nationkey AS VARCHAR) AS \"Nr\", n_name AS \"Name\", CAST(n_regionkey AS VARCHAR) AS \"Region [id]\" FROM nation")
def load_excel(spark, d):
    return files.read_excel(spark, _workbook(spark, d))


@query("load_xls", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 9 > 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation, c_mktsegment || ' ü€' AS segment FROM customer")
def load_xls(spark, d):
    """Customers in books of up to 5,000 rows, each written and read again by a task."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 9 > 0, F.col("c_nationkey")).alias("nation"), F.concat("c_mktsegment", F.lit(" ü€")).alias("segment"))

    def book(part: pd.DataFrame) -> pd.DataFrame:
        head = [["Export"], [], ["Nr", "Name", "Nation", "Segment"]]
        rows = [[int(k), n, None if pd.isna(m) else int(m), a] for k, n, m, a in zip(part["c_custkey"], part["c_name"], part["nation"], part["segment"], strict=True)]
        return pd.DataFrame({"path": [f"{int(part['book'].iloc[0])}.xls"], "content": [xls.write_book({"Notes": [["none"]], "Data": head + rows})]})

    books = c.withColumn("book", F.floor(F.col("c_custkey") / 5000)).groupBy("book").applyInPandas(book, "path string, content binary")
    return files.sheet_rows(books, "Data").filter("row > 2").select(*[F.col("cells")[i].alias(n) for i, n in enumerate(("id", "name", "nation", "segment"))])


@query("sheet_cells", "SELECT n_name AS label, CAST(n_regionkey AS VARCHAR) AS beside, 'Tag' AS sheet, 2 AS header, 2 AS region, (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1) AS at_b4 FROM nation")
def sheet_cells(spark, d):
    """Of a journal of nations: the cell beside each name, a cell by its address, the header row and a column by its name without unit."""
    content = files.fetch(spark, _workbook(spark, d))
    grid = files.read_grid(content)
    head = grids.find_header_row(grid, ["Nr", "region"])
    common = (files.sheet_names(content)[0], head, grids.match_header("region", grid[head]), files.locate(grid, cell="B4"))
    found = [(row[1], files.locate(grid, row[1]), *common) for row in grid[head + 1 :]]
    return spark.createDataFrame(found, "label string, beside string, sheet string, header int, region int, at_b4 string")


@query("load_settings", "SELECT 'cal.r' || r_regionkey AS name, CAST(r_regionkey AS DOUBLE) + 0.5 AS value FROM region")
def load_settings(spark, d):
    rows = spark.read.parquet(f"{d}/region.parquet").collect()  # 5 rows
    xml = "<?xml version='1.0'?><s><cal>" + "".join(f"<r{r.r_regionkey}>{r.r_regionkey}.5</r{r.r_regionkey}>" for r in rows) + "<password>x</password></cal><other><r9>1</r9></other></s>"
    meta = files.read_xml_meta(spark, files.put_bytes(spark, _place(spark, "settings.xml"), xml.encode()), ["cal"])
    return spark.createDataFrame(list(meta.items()), "name string, value double")


@query("file_hashes", "SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_regionkey)) AS sha256, CAST(length(string_agg(r_name, chr(10) ORDER BY r_regionkey)) AS BIGINT) AS length FROM region")
def file_hashes(spark, d):
    rows = spark.read.parquet(f"{d}/region.parquet").orderBy("r_regionkey").collect()  # 5 rows
    path = files.put_bytes(spark, _place(spark, "names.txt"), "\n".join(r.r_name for r in rows).encode())
    return files.sha256(spark, path).select("sha256", "length")


_HEADS = {
    "a.csv": ("frame,timestamp,mass_g,raw_text,is_valid\n", "video_readings"), "b.CSV": ('"Time";"Conc [mgC]";"Signal";"TempFID"\n', "analyser_csv"), "c.dat": ("Time\tConc [mgC]\tSignal\n", "analyser_text"), "d.txt": (";Letzte (C);\n", "thermocouple_logger"),
    "Settings_1.xml": ("<?xml version='1.0'?><a><calib_data/></a>", "analyser_settings"), "e.csv": ("time,x\n", None),
}


@query("profile_of_file", "SELECT c_custkey || '-' || f.file AS file, f.profile FROM customer JOIN (VALUES " + ", ".join(f"({i}, '{n}', {repr(p) if p else 'NULL'})" for i, (n, (_, p)) in enumerate(_HEADS.items())) + ") f(i, file, profile) ON c_custkey % 6 = f.i")
def profile_of_file(spark, d):
    """Each customer's file, of one of six kinds, by its name and first bytes; heads are looked at where they are read."""
    kinds = spark.createDataFrame([(i, n, head.encode()) for i, (n, (head, _)) in enumerate(_HEADS.items())], "i long, name string, head binary")
    heads = spark.read.parquet(f"{d}/customer.parquet").withColumn("i", F.col("c_custkey") % 6).join(F.broadcast(kinds), "i").select(F.concat_ws("-", "c_custkey", "name").alias("file"), "head")

    def found(parts):
        for part in parts:
            names = [getattr(detect(SHIPPED, n, bytes(h)), "name", None) for n, h in zip(part["file"], part["head"], strict=True)]
            yield pd.DataFrame({"file": part["file"], "profile": pd.Series(names, dtype=object, index=part.index)})

    return heads.mapInPandas(found, "file string, profile string")


@query("load_by_profile", "SELECT CAST(n_nationkey AS BIGINT) AS frame, n_regionkey * 1.5 AS mass_g, n_name AS raw_text, CAST(1 AS DOUBLE) AS is_valid FROM nation")
def load_by_profile(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    row = F.concat_ws(",", "n_nationkey", F.format_string("2024-05-06 07:08:%02d", "n_nationkey"), (F.col("n_regionkey") * 1.5).cast("string"), "n_name", F.lit("1"))
    head = spark.createDataFrame([(-1, "frame,timestamp,mass_g,raw_text,is_valid")], "at long, value string")
    path = _lines(spark, n.select(F.col("n_nationkey").cast("long").alias("at"), row.alias("value")).unionByName(head), "video.csv")
    return loader.load_any(spark, path).data.df.select("frame", "mass_g", "raw_text", "is_valid")


@query("load_many", "SELECT CAST(n_nationkey AS DOUBLE) AS time_seconds, CAST(n_regionkey + CASE WHEN n_nationkey >= 10 THEN 100 ELSE 0 END AS DOUBLE) AS x, CASE WHEN n_nationkey >= 10 THEN 1 ELSE 0 END AS source_no FROM nation")
def load_many(spark, d):
    """Two files that overlap, the first one given twice."""
    rows = spark.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
    text = lambda low, high, plus: ("time,x\n" + "".join(f"{r.n_nationkey},{r.n_regionkey + plus}\n" for r in rows if low <= r.n_nationkey < high)).encode()
    a, b, c = (files.put_bytes(spark, _place(spark, f"{n}.csv"), t) for n, t in (("a", text(0, 15, 0)), ("b", text(10, 99, 100)), ("again", text(0, 15, 0))))
    return loader.load_many(spark, [a, b, c])[0].select("time_seconds", "x", "source_no")


@query("written_result", "SELECT n_nationkey || ';' || n_name || ';' AS line FROM nation UNION ALL SELECT 'n_nationkey;n_name;none'")
def written_result(spark, d):
    path = _place(spark, "result")
    files.write_result(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")).coalesce(1), path)
    return spark.read.text(path).select(F.regexp_replace("value", '""$', "").alias("line"))


@query("written_analysis", "SELECT '# analysis: sums' AS line UNION ALL SELECT '# rests on: nation' UNION ALL SELECT 'n_regionkey;n' UNION ALL SELECT n_regionkey || ';' || count(*) FROM nation GROUP BY n_regionkey")
def written_analysis(spark, d):
    path = _place(spark, "analysis")
    n = spark.read.parquet(f"{d}/nation.parquet").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    files.write_analysis(n, path, "sums", {"rests on": "nation"})
    return spark.read.text(path).select(F.col("value").alias("line"))


_ROLES = """WITH e AS (SELECT user_id AS t, event_type AS v, user_id, event_id, length(event_type) AS kind FROM events), c AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, (SELECT max(d) FROM (SELECT count(DISTINCT {c}) AS d FROM e GROUP BY t)) AS at_time, (SELECT max(d) FROM (SELECT count(DISTINCT {c}) AS d FROM e GROUP BY v)) AS of_variable" for c in ("user_id", "event_id", "kind")
) + ")"


@query("long_roles", f"""{_ROLES} SELECT 'event_type' AS variable, 'value' AS "value", coalesce((SELECT string_agg(c, ',') FROM c WHERE at_time > 1 AND of_variable <= 1), '') AS attributes,
  coalesce((SELECT string_agg(c, ',') FROM c WHERE at_time <= 1), '') AS metadata, coalesce((SELECT string_agg(c, ',') FROM c WHERE at_time > 1 AND of_variable > 1), '') AS dropped WHERE (SELECT count(DISTINCT v) > 1 AND count(DISTINCT t) < count(*) FROM e)""")
def long_roles(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("t"), "user_id", "event_id", "event_type", F.length("event_type").alias("kind"), "value")
    r = roles.long_roles(e, {"event_type": "categorical", "value": "numeric"}, "t", variable="event_type")
    return spark.createDataFrame([(r.variable, r.value, ",".join(r.attributes), ",".join(r.metadata), ",".join(r.dropped))], "variable string, value string, attributes string, metadata string, dropped string")


@query("quality_settings", f"""SELECT (SELECT max(threshold) FROM (SELECT user_id, 10 * step AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY row)) AS step FROM {REC} WHERE value IS NOT NULL) WHERE step > 0) WHERE place = floor((n - 1) * 0.99 + 0.5) + 1)) AS jump,
  (SELECT max(w) FROM (SELECT median(dt) * 21 / 1e6 AS w FROM (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY row) AS dt FROM {REC}) WHERE dt > 0 GROUP BY user_id)) AS window_s, 'sparse' AS calculated""")
def quality_settings(spark, d):
    rec = recording(spark, d)
    s = roles.resolve_quality(roles.QualitySettings(spike_channels=("value",)), rec, {"sparse": {"is_calculated": "1"}})
    return spark.createDataFrame([(s.jump_thresholds["value"], s.spike_window_s, ",".join(s.calculated))], "jump double, window_s double, calculated string")
