"""Queries on ratings, experiments and telemetry, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasemill import fixtures
from phrasemill.functions import scores as s
from phrasemill.functions import words as lists
from phrasemill.operators import feedback as f
from phrasemill.operators import telemetry as m
from phrasemill.operators import tuning as u
from phrasemill.plans import duck
from phrasemill.plans.numbers import _POP, pop, rounded


def view(name):
    return lambda sp, d: fixtures.view(sp, d, name)


ratings, experiments = view("ratings"), view("experiments")


def telemetry(sp, d):
    return fixtures.view(sp, d, "telemetry").withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def log(sp, d):
    return experiments(sp, d).withColumn("composite", F.round(s.composite(F.col("quality"), F.col("separation")), 6))


def kept(sp, d):
    return u.keep_or_discard(log(sp, d), 0.1)


def axes(sp, d):
    i = F.col("doc_id")
    return fixtures.view(sp, d, "labels").select("doc_id", (1 + i % 10).alias("coherence"), (1 + 3 * i % 10).alias("evocativeness"), (1 + 7 * i % 10).alias("surprise"), (i % 6).alias("level"), (i % 3 == 0).alias("remixed"))


def spot(sp, d):
    return ratings(sp, d).select((F.col("id") % 3).alias("session"), (F.col("id") % 12).alias("batch"), F.col("tone_override").alias("felt"), F.col("system_tone").alias("target"), F.col("tone_override").isNull().alias("skipped"))


def R(q, views=("ratings",), more=""):
    return fixtures.with_views(list(views), more + "\n" + q)


NEW50 = ", nw as (select * from ratings order by created_at desc, id desc limit {0})"
_TAGS = "case when json_valid(tags) then json_extract_string(tags, '$[*]') else [] end"
_LOG = ", lg as (select *, round(0.5 * quality + 0.5 * separation, 6) as composite from experiments), kp as (select *, case when composite > greatest(0.1, coalesce(max(composite) over (order by iteration rows between unbounded preceding and 1 preceding), 0.1)) then 'keep' else 'discard' end as status from lg)"
_AX = "ax as (select doc_id, 1 + doc_id % 10 as coherence, 1 + 3 * doc_id % 10 as evocativeness, 1 + 7 * doc_id % 10 as surprise, doc_id % 6 as level, doc_id % 3 = 0 as remixed from labels)"
_AXQ = "round(avg(coherence), 6) as coherence, round(avg(evocativeness), 6) as evocativeness, round(avg(surprise), 6) as surprise, round(avg((coherence + evocativeness + surprise) / 3), 6) as overall, round(sum(coherence + evocativeness + surprise) / (30 * count(*)), 6) as quality, count(*) as n"


def windows(width, pred):
    return fixtures.with_views(["telemetry"], f"select time_bucket(interval {width}, timestamp) as window_start, count(*) as n, array_to_string(list_sort(list(distinct name))[1:10], ', ') as names, min(severity_level) as code from telemetry where {pred} group by 1")


def ntz(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES = {
    "a09_pull_new": (
        lambda sp, d: f.pull_new(ratings(sp, d).select(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("row_key"), "id", "source"), ratings(sp, d).where("id % 2 = 0").select(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("row_key")), "2024-01-10"),
        R("select strftime(created_at, '%Y-%m-%dT%H:%M:%S') as row_key, id, source from ratings where strftime(created_at, '%Y-%m-%dT%H:%M:%S') >= '2024-01-10' and strftime(created_at, '%Y-%m-%dT%H:%M:%S') not in (select strftime(created_at, '%Y-%m-%dT%H:%M:%S') from ratings where id % 2 = 0)"),
    ),
    "b25_rating_errors": (
        lambda sp, d: ratings(sp, d).select("id", f.rating_error(F.when(F.col("id") % 11 != 0, F.col("subtitle")), F.when(F.col("id") % 13 == 0, 5).otherwise(F.col("thumbs")), F.when(F.col("id") % 17 == 0, F.lit("odd")).otherwise(F.col("tone_override")), F.when(F.col("id") % 19 == 0, F.array(F.lit("weird"))).otherwise(f.tags_of(F.col("tags")))).alias("error")),
        R("select id, case when id % 11 = 0 then 'subtitle is required' when id % 13 = 0 then 'thumbs must be 1 or -1' when id % 17 = 0 then 'unknown tone' when id % 19 = 0 then 'unknown tag' end as error from ratings"),
    ),
    "b26_request_errors": (
        lambda sp, d: fixtures.view(sp, d, "orders").select("o_orderkey", f.request_error(F.when(F.col("o_orderkey") % 7 == 0, F.lit("Pop, odd")).otherwise(F.lit("pop,niche")), F.when(F.col("o_orderkey") % 5 == 0, F.create_map(F.lit("of_head"), F.lit("x"), F.lit("of_topic"), F.lit("y"))).when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("of_object"), F.lit("x"), F.lit("of_head"), F.lit("y"))).when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("what"), F.lit("x")))).alias("error")),
        "select o_orderkey, case when o_orderkey % 7 = 0 then 'unknown tone' when o_orderkey % 5 = 0 then 'mixed part locks' when o_orderkey % 3 = 0 then 'object and part locks' when o_orderkey % 2 = 0 then 'unknown lock' end as error from orders",
    ),
    "b27_telemetry_filters": (
        lambda sp, d: m.failures(telemetry(sp, d)).select("event_id", F.lit("failure").alias("kind")).unionByName(m.errors(telemetry(sp, d)).select("event_id", F.lit("error").alias("kind"))).unionByName(m.browser_exceptions(telemetry(sp, d)).select("event_id", F.lit("browser").alias("kind"))),
        R("select event_id, 'failure' as kind from telemetry where not success union all select event_id, 'error' from telemetry where severity_level >= 3 union all select event_id, 'browser' from telemetry where client_type = 'Browser'", ("telemetry",)),
    ),
    "b28_select_ratings": (lambda sp, d: f.select_ratings(ratings(sp, d), "2024-01-15 00:00:00", "web_user").select("id", "source"), R("select id, source from ratings where created_at >= timestamp '2024-01-15 00:00:00' and source = 'web_user'")),
    "c06_scores_by_filler": (
        lambda sp, d: rounded(f.scores_by_filler(fixtures.view(sp, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 == 0, F.lit("unknown")).otherwise(F.col("p_name")).alias("filler")), pop(sp, d).withColumn("slot_type", F.lit("of_object"))), "popularity"),
        fixtures.with_views(["signals"], f", {_POP} select id, p.filler, coalesce(freq, 1) as freq, round(popularity, 6) as popularity from (select p_partkey as id, case when p_partkey % 9 = 0 then 'unknown' else p_name end as filler from part) p left join pop on pop.filler = p.filler"),
    ),
    "c07_d19_d20_separation": (
        lambda sp, d: (lambda sc: rounded(f.histogram_overlap(sc, "tone", "pop", "niche"), "overlap", "separation"))(f.scores_by_slot(fixtures.view(sp, d, "part").select(F.col("p_partkey").alias("id"), F.lit("of_object").alias("slot_type"), F.when(F.col("p_partkey") % 9 == 0, F.lit("unknown")).otherwise(F.col("p_name")).alias("filler")), pop(sp, d).withColumn("slot_type", F.lit("of_object"))).select(F.when(F.col("id") % 2 == 0, "pop").otherwise("niche").alias("tone"), (F.log10(1 + F.col("freq")) / 2 + F.col("popularity") / 2).alias("score"))),
        fixtures.with_views(["signals"], f""", {_POP}, sc as (select case when id % 2 = 0 then 'pop' else 'niche' end as tone, log10(1 + coalesce(freq, 0)) / 2 + coalesce(popularity, 0.1) / 2 as score from (select p_partkey as id, case when p_partkey % 9 = 0 then 'unknown' else p_name end as filler from part) p left join pop using (filler)),
        h as (select greatest(0, least(9, cast(floor(score / 0.3) as int))) as bin, count(*) filter (tone = 'pop') as x, count(*) filter (tone = 'niche') as y from sc group by 1) select round(o, 6) as overlap, round(1 - o, 6) as separation from (select sum(least(x / (select sum(x) from h), y / (select sum(y) from h))) as o from h) z"""),
    ),
    "d16_axes": (lambda sp, d: rounded(u.axis_summary(axes(sp, d)), "coherence", "evocativeness", "surprise", "overall", "quality"), f"with {_AX} select {_AXQ} from ax"),
    "d17_remix_rate": (lambda sp, d: axes(sp, d).groupBy("level").agg(F.round(F.avg(F.col("remixed").cast("int")), 6).alias("remix_rate")), f"with {_AX} select level, round(avg(cast(remixed as int)), 6) as remix_rate from ax group by level"),
    "f06_t01_best_level": (
        lambda sp, d: u.best_level(rounded(u.axis_summary(axes(sp, d), "level"), "quality"), "level", "quality"),
        f"with {_AX}, q as (select level, round(sum(coherence + evocativeness + surprise) / (30 * count(*)), 6) as quality from ax group by level) select (select level from q order by quality desc, level limit 1) as best_level, max(quality) as best_score from q",
    ),
    "d21_summary": (
        lambda sp, d: rounded(f.summary(ratings(sp, d)), "approval_rate", "tone_accuracy"),
        R("select count(*) as total_ratings, count(thumbs) as thumbs_rated, round(avg(case when thumbs is not null then cast(thumbs = 1 as int) end), 6) as approval_rate, count(*) filter (system_tone is not null and tone_override is not null) as tone_pairs, round(avg(cast(system_tone = tone_override as int)), 6) as tone_accuracy from nw having count(*) >= 10", more=NEW50.format(50)),
    ),
    "d22_f04_mismatches": (lambda sp, d: f.mismatches(ratings(sp, d)), R("select 'system=' || system_tone || ' but human=' || tone_override as pattern, count(*) as count from nw where system_tone <> tone_override group by 1 order by 2 desc, 1 limit 5", more=NEW50.format(50))),
    "d23_tag_counts": (lambda sp, d: f.tag_counts(ratings(sp, d), None), R("select tag, count(*) as count from (select unnest(" + _TAGS + ") as tag from ratings) x group by 1")),
    "d24_review": (
        lambda sp, d: rounded(f.review(ratings(sp, d)), "share"),
        R("select case when system_tone = tone_override then 'match' else system_tone || '->' || tone_override end as direction, count(*) as count, round(count(*) / (select count(*) from nw where tone_override is not null and system_tone is not null), 6) as share from nw where tone_override is not null and system_tone is not null group by 1", more=NEW50.format(100)),
    ),
    "d24_examples": (lambda sp, d: f.mismatch_examples(ratings(sp, d)), R("select id, system_tone, tone_override, subtitle from nw where system_tone <> tone_override order by created_at desc, id desc limit 10", more=NEW50.format(100))),
    "e06_recent": (lambda sp, d: f.recent(ratings(sp, d), "tone_override", 20, 5), R("select id, tone_override from nw where coalesce(tone_override, '') <> '' order by created_at desc, id desc limit 5", more=NEW50.format(20))),
    "d29_spot_check_stats": (
        lambda sp, d: rounded(f.spot_check_stats(spot(sp, d)), "accuracy"),
        R("select session, batch, count(*) filter (not skipped) as rated, count(*) filter (not skipped and felt = target) as correct, count(*) filter (skipped) as skipped, round(case when count(*) filter (not skipped) > 0 then count(*) filter (not skipped and felt = target) / count(*) filter (not skipped) else 0 end, 6) as accuracy from (select id % 3 as session, id % 12 as batch, tone_override as felt, system_tone as target, tone_override is null as skipped from ratings) x group by grouping sets ((session, batch), (session))"),
    ),
    "k08_spot_check_thumbs": (lambda sp, d: ratings(sp, d).select("id", f.spot_check_thumbs(F.col("tone_override"), F.col("system_tone"), F.col("tone_override").isNull()).alias("thumbs")), R("select id, case when tone_override is not null then case when tone_override = system_tone then 1 else -1 end end as thumbs from ratings")),
    "d25_param_stats": (lambda sp, d: rounded(u.param_stats(kept(sp, d)), "avg_composite"), R("select param, count(*) as attempts, count(*) filter (status = 'keep') as kept, max(composite) as best_composite, round(avg(composite), 6) as avg_composite, cast(round(count(*) filter (status = 'keep') / count(*) * 100) as int) as keep_rate from kp group by param", ("experiments",), _LOG)),
    "d26_log_totals": (
        lambda sp, d: rounded(u.log_totals(kept(sp, d)), "mean", "quality_range", "separation_range", "kept_pct"),
        R("select count(*) as experiments, count(*) filter (status = 'keep') as kept, max(composite) as best, (select iteration from kp order by composite desc, iteration limit 1) as best_at, min(composite) as worst, (select iteration from kp order by composite, iteration limit 1) as worst_at, round(avg(composite), 6) as mean, round(max(quality) - min(quality), 6) as quality_range, round(max(separation) - min(separation), 6) as separation_range, count(distinct param) as params, round(100 * count(*) filter (status = 'keep') / count(*), 6) as kept_pct from kp", ("experiments",), _LOG),
    ),
    "e03_running_best": (lambda sp, d: u.running_best(log(sp, d)).select("iteration", "best"), R("select iteration, max(composite) over (order by iteration) as best from lg", ("experiments",), _LOG)),
    "e04_keep_or_discard": (lambda sp, d: kept(sp, d).select("iteration", "composite", "status"), R("select iteration, composite, status from kp", ("experiments",), _LOG)),
    "e05_value_path": (lambda sp, d: u.value_path(log(sp, d)).select("iteration", "param", "old_value", "new_value"), R("select iteration, param, lag(new_value) over (partition by param order by iteration) as old_value, new_value from lg", ("experiments",), _LOG)),
    "e12_log_context": (
        lambda sp, d: u.log_context(experiments(sp, d).withColumn("param", F.when(F.col("iteration") % 97 == 0, F.lit(u.REGIME)).otherwise(F.col("param")))).select("iteration", "param"),
        R("select iteration, param from (select iteration, case when iteration % 97 = 0 then '[regime change]' else param end as param, row_number() over (order by iteration desc) as rn from experiments) x where rn <= 20 or param = '[regime change]'", ("experiments",)),
    ),
    "t04_regime_change": (
        lambda sp, d: u.regime_change(experiments(sp, d).withColumn("description", F.lit(None).cast("string")), sp.createDataFrame(list(lists.PARAMS), "key string, value double")),
        R(f", {duck.PARAMS} select 'added' as change, key from params where key not in (select param from experiments)", ("experiments",)),
    ),
    "t05_prefer_round": (
        lambda sp, d: experiments(sp, d).select("iteration", u.prefer_round(F.col("quality"), F.col("separation"), F.col("new_value"), F.round("new_value", 1)).alias("chosen")),
        R("select iteration, case when separation >= (1 - 0.02) * quality then round(new_value, 1) else new_value end as chosen from experiments", ("experiments",)),
    ),
    "t06_pareto": (
        lambda sp, d: u.pareto(log(sp, d)).select("iteration", "frontier"),
        R(", bq as (select quality, top, max(top) over (order by quality desc rows between unbounded preceding and 1 preceding) as above from (select quality, max(separation) as top from lg group by 1) z) select iteration, separation = top and (above is null or separation > above) as frontier from lg join bq using (quality)", ("experiments",), _LOG),
    ),
    "d27_s01_failure_windows": (lambda sp, d: ntz(m.windowed(m.failures(telemetry(sp, d)), "5 minutes")), windows("5 minute", "not success")),
    "s02_error_windows": (lambda sp, d: ntz(m.windowed(m.errors(telemetry(sp, d)), "15 minutes")), windows("15 minute", "severity_level >= 3")),
    "s02_browser_windows": (lambda sp, d: ntz(m.windowed(m.browser_exceptions(telemetry(sp, d)), "15 minutes")), windows("15 minute", "client_type = 'Browser'")),
    "d28_client_metrics": (
        lambda sp, d: rounded(m.client_metrics(telemetry(sp, d)), "mean_duration"),
        R("select name, cast(props->>'$.k' as int) % 2 as k_odd, round(avg(duration), 6) as mean_duration, count(*) filter (success) as successes, count(*) filter (not success) as errors, count(*) as total from telemetry group by 1, 2", ("telemetry",)),
    ),
    "e07_alert_state": (
        lambda sp, d: ntz(m.alert_state(m.windowed(m.failures(telemetry(sp, d)), "6 hours"), "6 hours")),
        R(", c as (select time_bucket(interval 6 hour, timestamp) as w, count(*) as n from telemetry where not success group by 1), sp as (select unnest(generate_series(min(w), max(w), interval 6 hour)) as w from c) select sp.w as window_start, coalesce(n, 0) as n, sum(cast(coalesce(n, 0) > 0 as int)) over (order by sp.w rows 2 preceding) >= 2 as alert from sp left join c on c.w = sp.w", ("telemetry",)),
    ),
    "s05_retained": (lambda sp, d: m.retained(telemetry(sp, d), 10).select("event_id"), R("select event_id from telemetry where timestamp >= (select max(timestamp) from telemetry) - interval 10 day", ("telemetry",))),
}
