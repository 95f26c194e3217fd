"""Work that is done once for what repeats: distinct phrases, distinct seeds."""

from pyspark.sql import functions as F

from phrasemill.functions import text as t
from phrasemill.operators import bibliography as b
from phrasemill.operators import generate as g
from phrasemill.operators import sampling as p
from phrasemill.session import materialise


def told(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_is_unicode_white_space(spark):
    own = spark.range(0x10000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    both = own.select(F.concat("c", F.lit("x"), "c").alias("x")).select(t.strip(F.col("x")).alias("a"), F.regexp_replace("x", r"(?U)^\s+|\s+$", "").alias("b"))
    assert both.where("not (a <=> b)").count() == 0


def test_cleaning_computes_the_subtitle_once(spark):
    raw = spark.createDataFrame([(1, "openlibrary", "T /", "eng", None, None, None, " a  long subtitle. "), (2, "part01", "U :", None, None, None, None, "four")], "id long, source_file string, title string, lang string, lccn string, isbn string, work_key string, raw_subtitle string")
    raw = raw.repartition(2)  # not a local relation
    out = b.clean_records(raw)
    assert [(r.id, r.title, r.subtitle) for r in out.collect()] == [(1, "T /", "a long subtitle")]
    assert told(out).count("regexp_replace(") <= 5  # one for the title, two for either rule


def test_matches_are_judged_by_distinct_phrase(spark):
    rows = [(i, "t", "s", ["Race", "Power", "x1999"] if i % 2 else ["Race", "Power"], "rise", "the", "anvil", "") for i in range(6)] + [(9, "t", "s", ["Race", "Power"], "blue", "the", "anvil", "")]
    found = spark.createDataFrame(rows, "subtitle_id long, title string, subtitle string, list_items array<string>, action_noun string, action_article string, of_object string, of_article string")
    out = b.validated(found, b.lexicon(spark))
    assert sorted((r.subtitle_id, tuple(r.list_items)) for r in out.collect()) == [(i, ("Race", "Power")) for i in range(6)]
    assert "regexp" not in told(out) and "rlike" not in told(out).lower()


def test_text_fillers_match_the_pattern_once(spark):
    texts = ["Race, Power, and the Rise of Home /", "no, and the", "A, B, and the C of D\n", "A\x1f, B, and the C of D", None]
    own = spark.createDataFrame([(x,) for x in texts], "x string").repartition(2)
    got = {r.x: r.f for r in own.select("x", t.text_fillers(F.col("x")).alias("f")).collect()}
    assert got == {texts[0]: ["Race", "Power", "Rise", "Home"], texts[1]: [], texts[2]: ["A", "B", "C", "D"], texts[3]: ["A\x1f", "B", "C", "D"], None: []}


def test_requests_of_one_seed_are_drawn_once(spark, monkeypatch):
    """Levels of a sweep repeat their seeds: as many draws and attempts are written for six levels as for one."""
    from phrasemill.operators import generate as g
    from phrasemill.operators import sampling as p

    pools = spark.createDataFrame([(k, f"{k} {i}", i + 1, None) for k in ("list_item", "action_noun", "of_object") for i in range(9)], "slot_type string, filler string, freq long, popularity double")
    parts = spark.createDataFrame([(k, f"{k[3:]}{i}", i + 1, None, None, None) for k in ("of_modifier", "of_head") for i in range(9)], "slot_type string, filler string, freq long, popularity double, pos_tag string, prep string")
    splits = spark.createDataFrame([(f"of_object {i}", "type1", None, 2) for i in range(9)], "filler string, remix_type string, remix_prep string, remix_word_count int")
    scalars = spark.createDataFrame([(k, f"{k[3:]}{i}", i / 10, 1.0) for k in ("of_modifier", "of_head") for i in range(9)], "slot_type string, filler string, centroid_dot double, norm_sq double")
    counts = spark.createDataFrame([], "slot_type string, filler_lc string, article string, n long")
    seen, write = {}, g.materialise

    def counted(df, name):
        out = write(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(g, "materialise", counted)

    def run(levels):
        seen.clear()
        req = spark.range(20).crossJoin(spark.createDataFrame([(float(x),) for x in levels], "min_sim double"))
        req = req.selectExpr("id * 100 + cast(min_sim * 10 as long) as req_id", "id as seed", "'' as tone", "1D as remix_prob", "min_sim", "cast(null as map<string,string>) as locks")
        rows = {r.req_id: tuple(r) for r in g.generate(req, pools, parts, splits, counts, scalars, p.defaults(spark), (1.0, 0.1, 0.1)).collect()}
        return rows, seen["accepted"], seen["attempts"]

    six, one = run((0.0, 0.2, 0.4, 0.6, 0.8, 0.9)), run((0.6,))
    assert six[1:] == one[1:]
    assert len(six[0]) == 120 and one[0].items() <= six[0].items()


def test_hopeless_tries_are_not_looked_up(spark, monkeypatch):
    """Where all fillers are far from the tone's target, nearly every try is refused by its luck alone; the fillers drawn are those of all tries."""
    pools = spark.createDataFrame([("action_noun", f"x{i}", 10**6 + i, [None, 0.5, 2.0][i % 3]) for i in range(60)] + [("of_object", f"y{i}", 1 + 40 * i, None) for i in range(60)], "slot_type string, filler string, freq long, popularity double")
    parts = spark.createDataFrame([], "slot_type string, filler string, freq long, popularity double, prep string")
    params = p.defaults(spark).withColumn("trial", F.lit(0).cast("long"))
    req = spark.createDataFrame([(0, x, k) for k, x in enumerate(["pop", "niche", ""] * 40)], "trial long, tone string, seed long")
    cum, terms = g._cumulated(pools, parts, params), g.draw_terms(req, params)
    draws = req.withColumn("slot", F.explode(F.array(F.lit("action_noun"), F.lit("of_object")))).join(terms, ["trial", "tone", "slot"]).withColumns({"pool": F.col("slot"), "draw": F.col("seed")})
    draws, asked, pick = materialise(draws, "draws"), [], p.pick

    def counted(tries, *a, **b):
        if a[0] is cum:
            asked.append(tries.where("slot = 'action_noun' and tone <> ''").count())
        return pick(tries, *a, **b)

    monkeypatch.setattr(p, "pick", counted)
    got = sorted(map(tuple, g.accepted(draws, cum, ("draw", "slot")).collect()))
    few = sum(asked)
    asked.clear()
    monkeypatch.setattr(g, "_likeliest", lambda rows, cum: spark.createDataFrame([], "trial long, tone string, slot string, pool string, most string"))
    assert got == sorted(map(tuple, g.accepted(draws, cum, ("draw", "slot")).collect())) and len(got) == 240
    assert few * 5 < sum(asked)


def test_templates_build_no_struct_for_each_token(spark):
    """Tokens are arrays of strings; structs are built for the open runs alone, which are part of the result."""
    texts = ["The rise of cold War; a furious attack, slowly", "Élan -- of ΑΣ İ 42 ½", "\x1f of \x1f", "of", "", None]
    own = spark.createDataFrame(list(enumerate(texts)), "id long, phrase string").repartition(2)
    out = b.templates(own, b.lexicon(spark))
    got = {r.id: (r.template, [tuple(x) for x in r.slot_data or []]) for r in out.collect()}
    assert got[0] == ("the NOUN of ADJ NOUN ; a ADJ NOUN , ADV", [("NOUN", "rise", False), ("ADJ", "cold", False), ("NOUN", "War", False), ("ADJ", "furious", False), ("NOUN", "attack", False), ("ADV", "slowly", False)])
    assert got[1] == ("NOUN - - of NOUN+ NUM+", [("NOUN", "Élan", False), ("NOUN", "ΑΣ İ", True), ("NUM", "42 ½", True)])
    assert got[2] == ("PUNCT of PUNCT", [("PUNCT", "\x1f", False)] * 2) and got[3] == ("of", []) and got[4] == ("", []) and got[5] == (None, [])
    project = [x for x in told(out).split("\n") if "Project" in x or "Generate" in x]
    assert sum(x.count("struct(") for x in project) == 1


def test_slices_of_a_stream_are_several_files(spark, small, monkeypatch):
    """A large log lands as several files a batch, written by one job and dated in order of time; its windows are those of the batch query."""
    from phrasemill.plans import logs, streams

    monkeypatch.setattr(streams, "FILE", 1000)
    path, each = streams._landed(spark, logs.telemetry(spark, small).select("timestamp"), "timestamp")
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_modification_time").alias("at")).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("timestamp").alias("n")).orderBy("at").collect()
    assert each > 1 and len(files) > streams.SLICES and sum(f.n for f in files) == 1000
    assert all(a.hi <= b.lo for a, b in zip(files, files[1:]))
    assert sorted(map(tuple, streams.alerts("browser")(spark, small).collect())) == sorted(map(tuple, logs.QUERIES["s02_browser_windows"][0](spark, small).select("window_start", "n", "names", "code").collect()))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_texts_to_score_are_dealt_over_the_cores(spark, small, tmp_path):
    from phrasemill.plans import generation as gen

    spark.range(200_000).selectExpr("id as p_partkey", "md5(cast(id as string)) as p_name").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert "RoundRobinPartitioning(4)" in gen.texts(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_an_upsert_works_on_written_rows(spark, tmp_path, monkeypatch):
    """Rows that come out of a wide shuffle are written once: the merge has partitions by their size, and nothing is left in memory."""
    from phrasemill.sources import keyed

    seen = []
    monkeypatch.setattr(keyed, "materialise", lambda df, name: seen.append(materialise(df, name)) or seen[-1])
    table = keyed.KeyedTable(spark, f"file://{tmp_path}/table", "key string, n long", ("key",), "n")
    wide = lambda rows: spark.createDataFrame(rows, "key string, n long").repartition(64, "key")
    assert table.upsert(wide([(str(i), i) for i in range(200)]), 0)
    assert table.upsert(wide([("3", None), ("4", 40)]), 1) and not table.upsert(wide([("5", 0)]), 1)
    assert {r.key: r.n for r in table.read().collect()} == {str(i): i for i in range(200) if i != 3} | {"4": 40}
    assert len(seen) == 2 and all(x.rdd.getNumPartitions() <= 8 for x in seen)
