import pytest
from pyspark.sql import functions as F

from leafmill.plans import workflows
from leafmill.sources.captures import CAPTURES, read_captures, stream_captures
from leafmill.sources.readonly import Refused, check_select
from leafmill.sources.tables import ResultTables, TableError, check_name, json_rows, shrink


@pytest.fixture
def tables(spark, request):
    return ResultTables(spark, "t_" + "".join(c for c in request.node.name if c.isalnum())[:40])


def _rows(spark):
    return spark.createDataFrame([("u1", "a", 5.0), ("u2", "b", 12.5), ("u3", "c", None)], "url string, title string, price double")


def test_names_and_statements(spark):
    assert check_name(" ok_1 ") == "ok_1"
    for bad in ("", "1a", "a-b", "a" * 64, "_x", "a;b"):
        with pytest.raises(TableError):
            check_name(bad)


MANY = ", ".join(str(k) for k in range(40))
QUERIES = f"""SELECT 1;
SELECT "it's 'reflect(x)'", 'it''s an update', 1 AS `update`
VALUES (1)
VALUES (upper('x'), current_date())
TABLE saved
SELECT {MANY}
SELECT replace(b, 'b', 'c') FROM saved WHERE b = 'delete drop' -- update
SELECT * FROM default.saved
WITH x AS (SELECT 1) SELECT * FROM x
WITH RECURSIVE q(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM q WHERE n < 5) SELECT * FROM q
FROM saved |> WHERE a > 1 |> SELECT b
SELECT a, sum(a) OVER w FROM saved WINDOW w AS (PARTITION BY b ORDER BY a)
SELECT * FROM saved LATERAL VIEW explode(array(a, a)) e AS z
SELECT * FROM range(5)
SELECT * FROM saved PIVOT (count(b) FOR a IN (1, 2))
SELECT a IN (SELECT a FROM saved), (SELECT max(a) FROM saved) FROM saved GROUP BY CUBE (a)""".splitlines()
OTHERS = f"""
DROP TABLE saved
SELECT 1; SELECT 2
WITH x AS (SELECT 1) INSERT INTO saved SELECT 1, 'x'
EXPLAIN SELECT 1
SET a=1
CALL x()
BEGIN SELECT 1; END
SELECT {MANY}, reflect('java.lang.System', 'currentTimeMillis')
SELECT builtin.reflect('java.lang.System', 'currentTimeMillis')
SELECT filter(array(1), x -> try_reflect('a', 'b'))
SELECT sum(a) OVER w FROM saved WINDOW w AS (ORDER BY java_method('a', 'b'))
SELECT (SELECT reflect('a', 'b'))
WITH q AS (SELECT reflect('a', 'b')) SELECT 1
VALUES (reflect('a', 'b'))
SELECT * FROM range(reflect('a', 'b'))
SELECT elsewhere.f(1)
SELECT TRANSFORM(a) USING 'cat' FROM saved
SELECT * FROM IDENTIFIER('saved')
SELECT IDENTIFIER('reflect')('a')
SELECT * FROM STREAM saved
SELECT * FROM saved VERSION AS OF 1
SELECT * FROM parquet.`/any/path`
SELECT * FROM `org.apache.spark.sql.parquet`.`/etc/x`
SELECT * FROM saved JOIN csv.`/x` USING (a)
SELECT 1 WHERE EXISTS (SELECT * FROM text.`/etc/x`)""".splitlines()


@pytest.fixture(scope="module")
def saved(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS default.saved (a INT, b STRING) USING parquet")


@pytest.mark.parametrize("sql", QUERIES)
def test_queries_are_read(spark, saved, sql):
    assert check_select(spark, sql) == sql
    spark.sql(sql)


@pytest.mark.parametrize("sql", OTHERS)
def test_whatever_does_more_is_refused(spark, saved, sql):
    with pytest.raises(Refused):
        check_select(spark, sql)
    with pytest.raises(TableError):
        ResultTables(spark).query(sql)


def test_save_describe_query_drop(spark, tables):
    info = tables.save("pages", _rows(spark))
    assert (info.row_count, info.columns) == (3, ["url", "title", "price"])
    assert [r["url"] for r in tables.query("SELECT url FROM pages WHERE price > 6").rows] == ["u2"]
    result = tables.query("SELECT * FROM pages ORDER BY url", max_rows=2)
    assert result.truncated and len(result.rows) == 2
    assert tables.describe("pages", sample=2).sample.count() == 2
    with pytest.raises(TableError):
        tables.save("pages", _rows(spark).limit(0))
    assert tables.read("pages").count() == 3
    assert tables.drop("pages") == 3 and not tables.exists("pages")
    with pytest.raises(TableError):
        tables.describe("pages")


def test_append_evolves_the_schema(spark, tables):
    tables.append("t", spark.createDataFrame([(1, "x")], "id bigint, name string"))
    tables.append("t", spark.createDataFrame([(2, 9.5, ["a"])], "id bigint, score double, tags array<string>"))
    tables.append("t", spark.createDataFrame([("n/a", None)], "id string, score double"))
    rows = {r.id: (r.name, r.score, r.tags) for r in tables.read("t").collect()}
    assert rows == {"1": ("x", None, None), "2": (None, "9.5", '["a"]'), "n/a": (None, None, None)}


def test_query_to_table_over_its_own_source(spark, tables):
    tables.save("t", _rows(spark).union(_rows(spark)))
    info, replaced, truncated = tables.query_to_table("SELECT DISTINCT url, title || '!' AS label FROM t", "t")
    assert (info.row_count, replaced, truncated) == (3, True, False)
    info, replaced, truncated = tables.query_to_table("SELECT * FROM t", "u", max_rows=2)
    assert (info.row_count, replaced, truncated) == (2, False, True)
    with pytest.raises(TableError):
        tables.query_to_table("SELECT * FROM t WHERE url = 'none'", "v")
    assert [(r.name, r.row_count) for r in tables.list_tables().collect()] == [("t", 3), ("u", 2)]


def test_export(spark, tables, tmp_path):
    odd = spark.createDataFrame([("a,\"b\"\n", None), ("é", 2.0)], "url string, price double")
    tables.save("t", odd)
    csv = tables.export("t", " CSV ", str(tmp_path), single_file=True)
    back = spark.read.options(header="true", multiLine="true", escape='"').schema("url string, price double").csv(csv)
    assert sorted(back.collect()) == sorted(odd.collect())
    assert spark.read.schema("url string, price double").json(tables.export("t", "json", str(tmp_path))).count() == 2
    with pytest.raises(TableError):
        tables.export("t", "xlsx", str(tmp_path))


def test_overflow_is_saved_whole(spark, tables):
    rows = spark.range(3000).select("id", F.repeat(F.lit("x"), 20).alias("text"))
    for name, size in (("auto_op", 5), ("auto_op_2", 3000)):
        saved = tables.emit("op", rows.limit(size))
        assert (saved.name, saved.row_count) == (name, size)


def test_keys_that_differ_by_case_can_be_saved(spark, tables):
    df = spark.createDataFrame([(0, '{"Id":1}'), (1, '{"id":2}')], "ord int, obj string")
    tables.save("clash", json_rows(df))
    assert sorted(map(tuple, tables.read("clash").collect()), key=str) == [(1, None), (None, 2)]


def test_ragged_objects(spark):
    objects = [
        '{"b":null,"a":1}', '{"a":2,"c":[1,{"x":2}],"f":true}', '{"a":2.5,"b":"t","g":1}', '{"c":null,"d":0.5,"f":false,"g":"n/a"}', "[1]",
    ]
    df = spark.createDataFrame(list(enumerate(objects)), "ord int, obj string")
    got = json_rows(df)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [
        ("b", "string"), ("a", "double"), ("c", "string"), ("f", "bigint"), ("g", "string"), ("d", "double"),
    ]
    rows = [r.asDict() for r in got.collect()]
    assert [r["a"] for r in rows] == [1.0, 2.0, 2.5, None, None]
    assert [r["f"] for r in rows] == [None, 1, None, 0, None]
    assert [r["g"] for r in rows] == [None, None, "1", "n/a", None]
    assert rows[1]["c"] == '[1,{"x":2}]' and rows[3]["d"] == 0.5


def test_previews_are_shortened(spark):
    df = spark.createDataFrame([("x" * 250, 7)], "t string, n int")
    row = shrink(df).first()
    assert row.t == "x" * 200 + "… (+50 chars)" and row.n == 7


def test_capture_readers(spark, tmp_path):
    spark.createDataFrame([("https://a/", "<p>x</p>")], "url string, html string").write.parquet(str(tmp_path / "p"))
    df = read_captures(spark, str(tmp_path / "p"))
    assert set(CAPTURES.fieldNames()) == set(df.columns) and df.first().status_code == 200
    df.select(*CAPTURES.fieldNames()).write.json(str(tmp_path / "j"))
    assert read_captures(spark, str(tmp_path / "j"), "json").first().html == "<p>x</p>"
    assert stream_captures(spark, str(tmp_path / "p")).isStreaming


def test_contact_workflow(spark):
    def page(path, mail):
        return (f"https://s.example/{path}", f"<p>Mail {mail} or +44 7700 900123</p><a href='https://github.com/s'>g</a>")

    pages = [page("contact", "info@s.example"), page("Team/jo", "jo@s.example"), page("zzz", "late@s.example")]
    df = spark.createDataFrame(pages, "url string, html string")
    got = {(r.type, r.value): (r.pages, r.shared) for r in workflows.find_contacts(df, per_site=2).collect()}
    assert got == {
        ("email", "info@s.example"): (1, True), ("email", "jo@s.example"): (1, False),
        ("phone", "+44 7700 900123"): (2, False), ("github", "https://github.com/s"): (2, False),
    }
    summary = {r.type: (r.contacts, r.shared) for r in workflows.contact_summary(workflows.find_contacts(df)).collect()}
    assert summary == {"email": (3, 1), "phone": (1, 0), "github": (1, 0)}


def test_an_append_writes_only_new_files_and_a_failed_save_loses_nothing(spark, tables):
    tables.save("t", spark.createDataFrame([(1, "x")], "id int, name string"))
    before = tables.read("t").inputFiles()
    tables.append("t", spark.createDataFrame([("n/a", "y")], "ID string, name string"))
    tables.append("t", spark.createDataFrame([("2", "z")], "id string, name string"))
    assert set(before) <= set(tables.read("t").inputFiles())
    assert sorted(tuple(r) for r in tables.read("t").collect()) == [("1", "x"), ("2", "z"), ("n/a", "y")]
    broken = spark.range(5).select(F.expr("CAST(raise_error('broken') AS STRING)").alias("id"))
    for write in (tables.save, tables.append):
        with pytest.raises(Exception, match="broken"):
            write("t", broken)
    assert tables.read("t").count() == 3
    with pytest.raises(TableError):
        tables.append("t", tables.read("t").limit(0))
    assert [r["name"] for r in tables.list_tables().collect()] == ["t"]
    tables.save("t", tables.read("t").filter("id = '1'"))
    assert tables.read("t").count() == 1 and len(tables.read("t").inputFiles()) == 1


def test_a_plain_table_of_the_name_is_taken_over(spark, tables):
    spark.sql(f"CREATE TABLE {tables._full('plain')} (a INT) USING parquet")
    spark.sql(f"INSERT INTO {tables._full('plain')} VALUES (1)")
    tables.append("plain", spark.createDataFrame([(2,)], "a int"))
    assert sorted(r.a for r in tables.read("plain").collect()) == [1, 2]
    assert tables.drop("plain") == 2 and not tables.exists("plain")


def test_ragged_keys_beyond_the_width_go_into_a_map(spark):
    rows = spark.createDataFrame([(k, '{"id": %d, "k%d": [%d], "z": null}' % (k, k, k)) for k in range(500)], "ord int, obj string").repartition(5)
    wide = json_rows(rows, width=3)
    assert wide.columns == ["id", "k0", "z", "other_keys"]
    got = {r["id"]: (r["k0"], r["other_keys"]) for r in wide.collect()}
    assert got[0] == ("[0]", {}) and got[7] == (None, {"k7": "[7]"})
    assert json_rows(rows.filter("ord < 2"), width=4).columns == ["id", "k0", "z", "k1"]


def test_results_and_errors_are_saved_together(spark, tables):
    rows, errors = _rows(spark), spark.createDataFrame([("u9", "blocked: challenge")], "url string, error string")
    assert tables.emit("op", rows, errors, "found").row_count == 3 and tables.read("found_errors").count() == 1
    tables.emit("op", rows, errors.limit(0), "found", append=True)
    assert tables.read("found").count() == 6 and tables.read("found_errors").count() == 1
    assert tables.emit("op", rows).name == "auto_op" and not tables.exists("auto_op_errors")
    export = workflows.CatalogExport(
        spark.createDataFrame([], "store_url string, title string"), spark.createDataFrame([("s", 1, "v", 2.0, True), ("s", 2, "w", 3.0, False)], "store_url string, product_id long, vendor string, price double, available boolean"), None, errors,
    )
    saved = workflows.save_catalogs(tables, "shop", export)
    assert set(saved) == {"variants", "summary"} and tables.read("shop_summary").first()["out_of_stock"] == 1
    assert tables.read("shop_variants_errors").count() == 1
