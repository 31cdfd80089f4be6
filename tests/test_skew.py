"""Split joins and chunks give the rows of the plain forms, at any chunk size."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticketlens.operators import reports, skew, snapshot, stays
from ticketlens.operators.activities import activity_list
from ticketlens.operators.commands import apply_activity_commands, judge_commands, reject_commands
from ticketlens.plans import catalog, tracking
from ticketlens.sources.tables import life_rows


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_chunked_join_equals_left_join(spark, rows_of, monkeypatch, rows):
    monkeypatch.setattr(skew, "ROWS_PER_CHUNK", rows)
    rng = random.Random(5)
    keys = [1, 2, 3, 4, 5, None, 6]
    left = spark.createDataFrame([(rng.choice(keys), i) for i in range(300)], "k int, a int")
    right = spark.createDataFrame(
        [(rng.choice([1, 1, 1, 2, 4, 4, None, 8]), i) for i in range(120)], "k int, b int"
    )
    lefts, rights = skew.counts_of(left, "k", "nl"), skew.counts_of(right, "k", "nr")

    def counted(df):
        return df.join(lefts, "k", "left").join(rights, "k", "left")

    found = skew.chunked_join(counted(left), counted(right), "k", F.col("nl"), "nr").drop("nl", "nr")
    assert rows_of(found) == rows_of(left.join(right, "k", "left"))


def _life(spark, rows):
    life = spark.createDataFrame(rows, "vda_ta int, vda_seq int, vda_grupo int, vda_usuario int, t string")
    return life.select(
        "vda_ta", "vda_seq", "vda_grupo", "vda_usuario",
        F.col("t").cast("timestamp_ntz").alias("vda_data_initial"),
        F.lit(None).cast("timestamp_ntz").alias("vda_data_final"),
    )


def _plain_starts(base):
    """The previous user by one window over the whole ticket."""
    order = [F.col("data_entrada_n2").asc_nulls_last(), F.col("seq").asc_nulls_last()]
    whole = Window.partitionBy("origem").orderBy(*order)
    return stays._with_starts(base.withColumn("usuario_anterior", F.lag("usuario_cod").over(whole)))


@pytest.mark.parametrize("rows", [1, 7, 40, 10**6])
def test_stays_inside_one_minute_and_without_entry(spark, rows_of, monkeypatch, rows):
    monkeypatch.setattr(skew, "ROWS_PER_CHUNK", rows)
    rng = random.Random(11)
    data = [
        (1, i, 6611, rng.choice([None, 1, 2]), f"2018-11-04 00:0{rng.randrange(4)}:{i % 60:02d}")
        for i in range(200)
    ]
    data += [(1, 1000 + i, 6612, rng.choice([None, 1]), None) for i in range(90)]
    data += [(2, i, 6611, rng.choice([None, 1, 2]), "2018-11-05 10:00:00") for i in range(60)]
    data += [(2, None, 6611, 1, None), (3, 1, 6611, 2, "2018-11-05 10:00:00")]
    groups = spark.sql("select 6611 grp_codigo, 'A' grp_nome, 1 grp_pai")
    users = spark.sql("select 1 usr_codigo, 'U' usr_nome")
    base = stays.group_stays(_life(spark, data), groups, users, catalog.AS_OF)
    expected = rows_of(_plain_starts(base))
    zone = spark.conf.get("spark.sql.session.timeZone")
    # That hour does not exist in this zone.
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    found = rows_of(stays.mark_starts(base))
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == expected


NAMES = "select 6611 grp_codigo, 'A' grp_nome, 1 grp_pai", "select 1 usr_codigo, 'U' usr_nome"


@pytest.mark.parametrize("derived", [False, True])
def test_chunks_of_a_hot_ticket_are_bounded(spark, rows_of, monkeypatch, derived):
    """A third of the rows on one ticket, many without entry, numbered densely or by a hash
    of the row: no chunk holds the ticket, and there are few chunks."""
    monkeypatch.setattr(skew, "ROWS_PER_CHUNK", 50)
    rows = [(7 if i % 3 == 0 else i, i, 6611, i % 4, None if i % 2 else "2018-11-05 10:00:00") for i in range(6000)]
    life = _life(spark, rows)
    if derived:
        life = life_rows(life.withColumn("x", F.col("vda_seq")).drop("vda_seq")).drop("x")
    groups, users = map(spark.sql, NAMES)
    base = stays.group_stays(life, groups, users, catalog.AS_OF)
    light, hot = stays._split(base, stays.stays_per_ticket(life))
    assert hot.select("origem").distinct().collect() == [(7,)] and light.count() + hot.count() == 6000
    sizes = stays._in_chunks(hot).groupBy("origem", *stays.CHUNK).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 90 and sizes[1] <= 4 * 2000 / 50
    assert rows_of(stays.mark_starts(base)) == rows_of(_plain_starts(base))


def test_stays_travel_once(spark, tables):
    """Without heavy tickets the stays are shuffled once, by ticket; a first read counts them."""
    df = stays.stay_table(tables["vida"], tables["grupos"], tables["usuarios"], catalog.AS_OF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan parquet") <= 6 and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(origem") <= 2


def test_no_count_travels_with_the_rows(tables):
    """Counts by key are filtered to heavy keys and broadcast before they meet any row."""
    df = tracking.tracking_active(tables, catalog.AS_OF, catalog.START, catalog.END)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("GlobalLimit 100000") >= 3


def test_small_chunks_change_no_table(tables, rows_of, monkeypatch):
    args = tables, catalog.AS_OF, catalog.START, catalog.END, catalog.START
    life = tables["vida"], tables["grupos"], tables["usuarios"], catalog.AS_OF
    builds = [
        lambda: stays.stay_table(*life),
        lambda: tracking.tracking_unified(*args),
        lambda: tracking.unified_stays(*args, weighted=True),
        lambda: tracking.unified_sites(*args),
    ]
    plain = [rows_of(build()) for build in builds]
    monkeypatch.setattr(skew, "ROWS_PER_CHUNK", 2)
    assert [rows_of(build()) for build in builds] == plain
    monkeypatch.setattr(skew, "MOST_HEAVY", 3)  # the other heavy keys stay whole
    assert rows_of(builds[0]()) == plain[0]


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
def test_a_day_is_pruned_by_its_roots(spark, tables, rows_of, broadcast):
    """One day reaches life rows, procedures, elements and equipment as semi-joins."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, broadcast)
    try:
        day = tables, catalog.AS_OF, datetime(1996, 1, 2), datetime(1996, 1, 3)
        df = tracking.tracking_active(*day)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftSemi") >= 5
        found = rows_of(df)
    finally:
        spark.conf.set(key, before)
    whole = tracking.tracking_active(tables, catalog.AS_OF, catalog.START, catalog.END)
    low, high = day[2:]
    assert found == rows_of(whole.where((F.col("data_criacao") >= F.lit(str(low)).cast("timestamp_ntz")) & (F.col("data_criacao") < F.lit(str(high)).cast("timestamp_ntz"))))


def test_downloads_read_no_equipment(spark, sf_dir):
    plan = catalog.unified_download_month(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "hostname" not in plan and "pca_data" not in plan


@pytest.mark.parametrize("count", [0, 1000, 1001])
def test_attachments_have_one_shape(spark, count):
    activities = spark.sql(
        "select 1 id_atividade, '1' matricula, 'n' nome_usuario, 5 id_atividade_padrao, 's' status,"
        " timestamp_ntz '2024-01-01 00:00:00' data_inicio, cast(null as timestamp_ntz) data_fim,"
        " 1 tempo_estimado_min, 2 tempo_real_min, 'o' observacoes"
    )
    catalogue = spark.sql("select 5 id, 'x' nome_atividade")
    files = spark.range(count).selectExpr(
        "cast(id as int) id_arquivo", "1 id_atividade", "'a' nome_original", "'b' nome_arquivo",
        "'c' caminho", "'d' content_type", "id tamanho_bytes", "timestamp_ntz '2024-01-01' data_upload",
    )
    rows = activity_list(activities, catalogue, files, "/f/").collect()
    ids = [r["arquivo_id_arquivo"] for r in rows]
    assert ids == (list(range(count)) or [None])
    assert rows[0]["arquivo_url_download"] == ("/f/0" if count else None)


def test_commands_in_small_chunks(tables, rows_of, monkeypatch):
    given, catalogue, cmds = (tables[n] for n in ("atividade_suporte", "atividade_padrao", "comandos"))
    few = given.where("id_atividade % 2 = 0")

    def both():
        judged = judge_commands(few, catalogue, cmds)
        return rows_of(reject_commands(judged)), rows_of(apply_activity_commands(few, judged))

    plain = both()
    monkeypatch.setattr(skew, "ROWS_PER_CHUNK", 3)
    assert both() == plain


def test_a_heavy_part_adds_no_filter_below_the_shuffles(spark, rows_of):
    """Light and heavy rows come from one shuffle of the same rows, null keys among the light."""
    ids = spark.range(0, 60, 1, 3)
    df = ids.select(F.when(F.col("id") % 4 > 0, F.col("id") % 5).alias("k"), (F.col("id") % 9).alias("v")).distinct()
    sizes = skew.heavy(spark.createDataFrame([(2, 10**6)], "k long, n long"), ["k"], "n")
    light, hot = skew.split(df, sizes, "k")
    assert hot.columns == ["k", "v", "n"] and {r["k"] for r in hot.collect()} == {2}
    assert rows_of(light.unionByName(hot.drop("n"))) == rows_of(df)
    for part in (light, hot):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "isnotnull" not in plan[plan.index("Aggregate") : plan.index("Range")]


def test_heavy_stays_are_found_where_they_are_read(spark, rows_of, tables, monkeypatch):
    """The life rows of heavy tickets do not travel with those of a load."""
    monkeypatch.setattr(skew, "ROWS_PER_CHUNK", 2)
    life = tables["vida"].where("vda_ta % 3 = 0")
    chosen = life.join(tables["ta"].select(F.col("tqa_codigo").alias("c")), F.col("vda_ta") == F.col("c"), "left_semi")
    sizes = skew.heavy(stays.stays_per_ticket(chosen), ["origem"], "estadas")
    names = (tables["grupos"], tables["usuarios"], catalog.AS_OF)
    light, hot = stays.stay_parts(chosen, *names, sizes, tables["vida"])
    assert hot.count() > 0 and light.count() > 0
    assert rows_of(light.unionByName(hot.drop("estadas"))) == rows_of(stays.stay_table(chosen, *names))
    # The source is read as it is; only the counts of heavy tickets come from the load.
    read = stays.group_stays(skew.only_heavy(tables["vida"], "vda_ta", sizes), *names, keep=["estadas"])
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 1 and plan.index("strategy=broadcast") < plan.index("LeftSemi")


def test_rows_made_distinct_by_sorting(spark, rows_of):
    """As by `distinct`, nulls among keys and values, whatever columns are the keys."""
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([None, "", "x"])) for _ in range(300)]
    df = spark.createDataFrame(data, "origem int, site string, uf string")
    assert df.distinct().count() < 300
    for keys in (("origem",), ("uf", "origem")):
        assert rows_of(skew.distinct_sorted(df, *keys)) == rows_of(df.distinct())


def test_roots_of_both_kinds_are_read_once(spark, rows_of):
    days = [None, "1990-01-01 00:00:00", "1998-05-05 00:00:00", "2001-12-31 23:59:59", "2002-01-01 00:00:00"]
    rows = [
        (i, None if i % 7 else 1, status, 701 if i % 5 else None, created, closed)
        for i, (status, created, closed) in enumerate(
            (status, created, closed) for status in (None, 10, 20, 70, 90, 30) for created in days for closed in days
        )
    ]
    ta = spark.createDataFrame(
        rows, "tqa_codigo int, tqa_origem int, tqa_status int, tqa_tipo_rede int, aberto string, fechado string"
    ).selectExpr(
        "*", "cast(aberto as timestamp_ntz) tqa_data_criacao", "cast(fechado as timestamp_ntz) tqa_data_encerramento"
    )
    period = catalog.START, catalog.END
    active = snapshot.active_roots(ta, *period)
    closed = snapshot.closed_roots(ta, *period, catalog.START)
    both = snapshot.both_roots(ta, *period, catalog.START)
    assert active.count() and closed.count()
    assert rows_of(both) == rows_of(reports.unified_tracking(active, closed))
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString()


def test_a_download_sorts_each_table_once(spark, sf_dir):
    """Tables are not chosen by the tickets ahead of the joins with them, and no hash table holds
    the long rows: only the tickets are chosen, once each for light and for heavy ones."""
    df = catalog.unified_download_year(spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # Both branches of the stand-in table of tickets.
    assert plan.count("LeftSemi") <= 4
    long_rows = [line for line in plan.split("\n") if "Aggregate [" in line and "tempo_no_grupo" in line]
    assert not long_rows
