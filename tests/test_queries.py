import duckdb
import pytest

from lodestrata import plans

plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    r = duck.sql(plans.SQL[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=str)


def test_skip_packer_against_loop(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    for r in plans.QUERIES["budget_skip_fold"](spark, sf_dir).collect():
        used, picked = 0, []
        for d in docs:
            if d.source == r.source and used + d.n_chars <= 8000:
                used, picked = used + d.n_chars, [*picked, d.doc_id]
        assert (r.used, r.picked) == (used, picked)


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables of (id, text) rows and gives their folder."""

    def write(**rows):
        for name, (key, r) in rows.items():
            spark.createDataFrame(r, f"{key} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_short_items_meet_windows_of_their_length(spark, tables):
    docs = [(1, "One two, three four five six seven"), (2, "two three"), (3, "123"), (4, None), (5, "two three two three"), (None, "two three")]
    items = [(1, "two three"), (2, "three four five six seven"), (3, "..."), (4, None), (5, "one two three four five six and more"), (6, "hree"), (1, "two")]
    d = tables(documents=("doc_id", docs), benchmark=("item_id", items))
    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    got = {r.item_id: r.n_docs for r in plans.QUERIES["theta_phrase_contains"](spark, d).collect()}
    assert got == dict(connection.sql(plans.SQL["theta_phrase_contains"]).fetchall())
    assert got[2] == got[3] == 1 and got[1] == 6 and got[4] == got[5] == got[6] == 0


def test_all_secrets_are_searched_inside_runs(spark, tables):
    a, b = "Aa1" * 6, "Bb2" * 7
    docs = [(1, f"password={a} then token = {b}"), (2, f"see x{b}y"), (3, f"{a}{a}"), (4, b[:-1]), (5, None), (2, f"see x{b}y")]
    got = plans.QUERIES["leak_substring_scan"](spark, tables(documents=("doc_id", docs))).collect()
    assert sorted(map(tuple, got)) == sorted([(1, a, False), (1, b, False), (2, b, False), (2, b, False), (3, a, True)])
