"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from four patterns with their checks. Beyond them there are candidates of two more kinds: long tokens (``secret``) and grouped
numbers of 7 to 12 digits (``contact``, telephone numbers without a plus sign). Each kind has labelers that vote for, against or not at all: formats,
gazetteers of words in four languages, what stands before, entropy, and shapes that speak against. Votes are counted by pattern (3^6 rows a kind at
most); expectation-maximisation over these counts estimates how reliable each labeler is. The posteriors, summed by feature
value over all of them, train the final span classifier, whose log odds are then added up as column expressions. Grouped numbers inside base
phones are learned from as well (a labeler knows them by their prefix), but give no second span. Labelers, counts and sums cover all
documents; ``labelers`` reports coverage, conflicts and reliability. Texts of any length are read whole, in one value.

The patterns are the contract's, written so that Java matches them in linear time: possessive where nothing could be
given back, and started only where a run starts or the last match ended.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{12,}+",
    "contact": r"(?<![A-Za-z0-9+(.-])\(?[0-9]{2,5}+\)?(?:[ ./-][0-9]{2,5}+){1,4}+(?![A-Za-z0-9]|[.-][0-9])",
}
LEARNED = ("secret", "contact")
#: What the labelers learn from: the candidates and, as a background of secrets, long tokens without digits.
BACKGROUND = {"secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{12,}+", "contact": PATTERNS["contact"]}
#: Cheap tests that a text with a match passes.
GUARDS = {"email": r"[A-Za-z0-9._%+-]@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[0-9]", "contact": r"[0-9][)]?[ ./-][0-9]"}
CREDENTIAL_WORDS = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth|bearer|contraseña|clave|mot de passe|jeton|clé|passwort|kennwort|schlüssel"
CALL_WORDS = "phone|telephone|tel|mobile|cell|call|fax|contact|dial|teléfono|móvil|llamar|llame|téléphone|portable|appeler|appelez|telefon|handy|anrufen|rufnummer"
NUMBER_WORDS = "page|pages|pp|isbn|issn|vol|no|nr|id|version|lines?|since|between|from|de|von|total|score|years?|années|años|jahre"
EM_STEPS, ACCEPT = 60, 0.5
#: Features say in part what the votes have said already (a key's shape), so their log odds count for half.
FEATURE_TRUST = 0.5
_SPANS = "array<struct<s:int,e:int,t:string,before:string>>"


def _located(kind: str) -> Column:
    """Spans of the matches m between the gaps g: prefix sums of their lengths, in code points."""
    m, g = f"m_{kind}", f"g_{kind}"
    return F.expr(f"""case when size({m}) > 0 then aggregate(sequence(0, size({m}) - 1),
        named_struct('at', 0, 'out', cast(array() as {_SPANS})),
        (z, i) -> named_struct('at', z.at + length({g}[i]) + length({m}[i]), 'out', concat(z.out, array(named_struct(
            's', z.at + length({g}[i]), 'e', z.at + length({g}[i]) + length({m}[i]), 't', {m}[i], 'before', right({g}[i], 24))))),
        z -> z.out) else cast(array() as {_SPANS}) end""")


def _split(df: DataFrame, kinds) -> DataFrame:
    none = F.array().cast("array<string>")
    cols = {}
    for k in kinds:
        near = F.col("text").rlike(GUARDS[k])
        cols[f"m_{k}"] = F.when(near, F.regexp_extract_all("text", F.lit(PATTERNS[k]), 0)).otherwise(none)
    df = df.withColumns(cols)
    cols = {f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none) for k in kinds}
    return df.withColumns(cols).withColumns({k: _located(k) for k in kinds}).drop(*(f"{x}_{k}" for x in "mg" for k in kinds))


def _valid(kind: str) -> Column:
    digits = "regexp_replace(x.t, '[^0-9]', '')"
    luhn = f"aggregate(transform(sequence(1, length({digits})), i -> int(substring({digits}, -i, 1)) * (1 + (i + 1) % 2)), 0, (a, v) -> a + v - if(v > 9, 9, 0)) % 10 = 0"
    test = {
        "email": "true",
        "ip": "forall(split(x.t, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and int(right(p, 3)) <= 255)",
        "card": f"case when length({digits}) between 13 and 19 then {luhn} else false end",
        "phone": f"length({digits}) between 9 and 15",
    }[kind]
    return F.expr(f"filter({kind}, x -> {test})")


def base_spans(docs: DataFrame, more=()) -> DataFrame:
    """Adds an array of checked spans for each base kind, and of candidates for each of ``more``."""
    return _split(docs, (*KINDS, *more)).withColumns({k: _valid(k) for k in KINDS})


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else F.lit(False), -1).otherwise(0)


def _distinct(t: Column) -> Column:
    return F.size(F.array_distinct(F.split(F.lower(t), "")))


def _digits(t: Column) -> Column:
    return F.length(F.regexp_replace(t, "[^0-9]", ""))


def _votes(kind: str, c: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 for, -1 against, 0 none."""
    t, before = c.getField("t"), c.getField("before")
    if kind == "contact":
        date = "^(?:1[89]|20)[0-9]{2}[ ./-][0-9]{2}[ ./-][0-9]{2}(?![0-9])|^[0-9]{2}[./-][0-9]{2}[./-](?:1[89]|20)?[0-9]{2}(?![0-9])"
        years = "^(?:1[5-9]|20)[0-9]{2}(?:[ ./-](?:1[5-9]|20)[0-9]{2})+$"
        return {
            "format": _vote(t.rlike("^\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^0[1-9](?:[ .-][0-9]{2}){4}$|^\\(?0[0-9]{2,4}\\)?[ /-]"), t.rlike(date + "|" + years)),
            "international": _vote(before.rlike("\\+[0-9]{1,3}[ .-]?$")),
            "gazetteer": _vote(before.rlike(f"(?iu)(?<![\\p{{L}}])({CALL_WORDS})[.:]*\\s*(?:(?:at|on|no|nr|number|au|al|unter|me)[.:]*\\s*)?$"), before.rlike(f"(?iu)(?<![\\p{{L}}])({NUMBER_WORDS})[.:#]*\\s*$")),
            "place": _vote(F.lit(False), before.rlike("[$€£#=*/x,<>]\\s?$")),
            "grouping": _vote(t.rlike("^\\("), F.length(F.regexp_replace(t, "[^ ./-]", "")) < 2),
            "entropy": _vote(F.lit(False), _distinct(F.regexp_replace(t, "[^0-9]", "")) <= 2),
        }
    turns = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[^A-Za-z0-9]", ""), "[0-9]+", "0"), "[A-Za-z]+", "a"))
    words = f"(?iu)(?<![\\p{{L}}])({CREDENTIAL_WORDS})"
    return {
        "key": _vote(t.rlike("^AKIA[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abprs]-|^eyJ[A-Za-z0-9_-]{20,}|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{40}|[0-9A-F]{64})$")),
        "gazetteer": _vote(t.rlike(words + "[=_-]") | before.rlike(words + "[\"']?\\s*[:=]?\\s*[\"']?$")),
        "context": _vote(t.rlike("^[A-Za-z_]+=") | before.rlike("[:=]\\s*[\"']?$"), before.rlike("[#/@]$")),
        "mixed": _vote(turns >= 5, turns <= 2),
        "plain": _vote(F.lit(False), t.rlike("^[a-z]+[-_]?[0-9]+$|^[0-9]+[a-z]+$|^[0-9]{4}-[0-9]{2}-|^[A-Za-z]+([-/][A-Za-z]+)+")),
        "entropy": _vote((_distinct(t) >= 12) & (_digits(t) >= 3), _distinct(t) <= 7),
    }


def _features(kind: str, c: Column) -> dict[str, Column]:
    t, before = c.getField("t"), c.getField("before")
    opening = F.when(F.length(before) == 0, 0).when(before.rlike("\\s$"), 1).when(before.rlike("[\"':=]$"), 2).otherwise(3)
    if kind == "contact":
        return {"digits": _digits(t), "groups": F.size(F.split(t, "[^0-9]+")), "mark": F.regexp_extract(t, "[0-9]\\)?([ ./-])", 1), "opening": opening}
    share = lambda cls: F.floor(4 * F.length(F.regexp_replace(t, f"[^{cls}]", "")) / F.length(t))
    return {
        "length": F.least(F.floor(F.length(t) / 6), F.lit(8)),
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "assigned": F.instr(t, "=").cast("boolean").cast("int"),
        "opening": opening,
    }


def _named(kind: str, c: Column) -> list[Column]:
    return [F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in _features(kind, c).items()]


def estimate(patterns: list[tuple[tuple[int, ...], int]], steps: int = EM_STEPS) -> tuple[float, list[list[list[float]]], dict]:
    """EM over counted vote patterns -> share of class 1, P(vote | class) for each labeler, posterior of each pattern."""
    total = sum(n for _, n in patterns)
    # first guess: the majority of the votes
    post = {v: 0.9 if sum(v) > 0 else 0.02 if sum(v) < 0 else 0.1 for v, _ in patterns}
    prior, table, labelers = 0.5, [], range(len(patterns[0][0]) if patterns else 0)
    for _ in range(steps):
        mass = [sum(n * (1 - post[v]) for v, n in patterns), sum(n * post[v] for v, n in patterns)]
        prior = min(0.999, max(0.001, mass[1] / max(total, 1)))
        table = [[[(sum(n * (post[v] if c else 1 - post[v]) for v, n in patterns if v[k] == x - 1) + 0.5) / (mass[c] + 1.5) for x in range(3)] for c in range(2)] for k in labelers]
        for (no, yes) in table:  # a labeler is never worse than chance, or the classes could change places
            for x, sign in ((0, -1), (2, 1)):
                if sign * (yes[x] - no[x]) < 0:
                    yes[x] = no[x] = (yes[x] + no[x]) / 2
        for v in post:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[k][1][x + 1] / table[k][0][x + 1]) for k, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
    return prior, table, post


def _lookup(values: dict, key: Column, other: float) -> Column:
    if not values:
        return F.lit(other)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in chain(*values.items()))), key), F.lit(other))


def votes(docs: DataFrame) -> DataFrame:
    """kind, votes (comma list in the order of the kind's labelers), features (named, joined by spaces), n: all candidates of all documents, counted
    by what the labelers say; bounded by vote patterns x feature values."""
    own, none = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")), F.array().cast("array<string>")
    near = {"secret": F.lit(True), "contact": F.col("text").rlike(GUARDS["contact"])}
    own = own.withColumns({f"m_{k}": F.when(near[k], F.regexp_extract_all("text", F.lit(BACKGROUND[k]), 0)).otherwise(none) for k in LEARNED})
    own = own.withColumns({f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", BACKGROUND[k], -1)).otherwise(none) for k in LEARNED})

    def told(kind: str) -> Column:
        found = F.filter(F.arrays_zip(F.col(f"m_{kind}").alias("t"), F.col(f"g_{kind}").alias("g")), lambda z: z["t"].isNotNull() & (_digits(z["t"]).between(7, 12) if kind == "contact" else F.lit(True)))
        return F.transform(found, lambda z: F.struct(F.lit(kind).alias("kind"), z["t"].alias("t"), F.right(z["g"], F.lit(24)).alias("before")))

    rows = own.select(F.explode(F.concat(*map(told, LEARNED))).alias("c"))
    by_kind = lambda make: reduce(lambda a, k: F.when(F.col("c.kind") == k, make(k)).otherwise(a), LEARNED, F.lit(""))
    said = by_kind(lambda k: F.concat_ws(",", *(v.cast("string") for v in _votes(k, F.col("c")).values())))
    seen = by_kind(lambda k: F.concat_ws(";", *_named(k, F.col("c"))))
    return rows.select("c.kind", said.alias("votes"), seen.alias("features")).groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))


def _names(kind: str) -> list[str]:
    return list(_votes(kind, F.struct(F.lit("").alias("t"), F.lit("").alias("before"))))


def _fit(counted: list[tuple[tuple[int, ...], str, int]], names: list[str]) -> dict:
    patterns: dict[tuple[int, ...], int] = {}
    for v, _, n in counted:
        patterns[v] = patterns.get(v, 0) + n
    prior, table, post = estimate(sorted(patterns.items()))
    sums: dict[str, list[float]] = {}
    mass = [1.0, 1.0]
    for v, features, n in counted:
        for c, w in enumerate((1 - post[v], post[v])):
            mass[c] += w * n
            for k in features.split(";"):
                sums.setdefault(k, [0.5, 0.5])[c] += w * n
    weights = {k: math.log(a[1] / mass[1]) - math.log(a[0] / mass[0]) for k, a in sorted(sums.items())}
    # a labeler's vote is a feature too, weighed by its estimated reliability
    vote_weights = {f"{name}{x - 1}": math.log(table[k][1][x] / table[k][0][x]) for k, name in enumerate(names) for x in (0, 2)} if patterns else {}
    return {"prior": math.log(prior / (1 - prior)), "weights": weights, "votes": vote_weights, "post": post, "patterns": patterns}


def fit(docs: DataFrame) -> dict[str, dict]:
    """kind -> reliabilities and the weights of the span classifier, from all candidates of all documents."""
    counted = sorted((r["kind"], tuple(map(int, r["votes"].split(","))), r["features"], r["n"]) for r in votes(docs).collect())
    return {kind: _fit([(v, x, n) for k, v, x, n in counted if k == kind], _names(kind)) for kind in LEARNED}


def labelers(docs: DataFrame) -> DataFrame:
    """kind, labeler, n_for, n_against (candidates that it votes on), n_conflict (of these, where another labeler votes the other way), agrees (the share
    of its votes that the estimate confirms; null without votes): what each labeler does on these documents."""
    out = []
    for kind, model in fit(docs.select("text")).items():
        for k, name in enumerate(_names(kind)):
            on = [(v, n, model["post"][v]) for v, n in model["patterns"].items() if v[k]]
            clash = sum(n for v, n, _ in on if -v[k] in v)
            right = sum(n * (q if v[k] > 0 else 1 - q) for v, n, q in on)
            total = sum(n for _, n, _ in on)
            out.append((kind, name, sum(n for v, n, _ in on if v[k] > 0), sum(n for v, n, _ in on if v[k] < 0), clash, right / total if total else None))
    return docs.sparkSession.createDataFrame(out, "kind string, labeler string, n_for long, n_against long, n_conflict long, agrees double")


def _accepted(kind: str, model: dict) -> Column:
    """Candidates whose votes, weighed by reliability, and features together speak for the kind."""

    def odds(c: Column) -> Column:
        said = [_lookup(model["votes"], F.concat(F.lit(k), v.cast("string")), 0.0) for k, v in _votes(kind, c).items()]
        features = [_lookup(model["weights"], name, 0.0) for name in _named(kind, c)]
        return reduce(lambda a, b: a + b, said) + FEATURE_TRUST * reduce(lambda a, b: a + b, features) + F.lit(model["prior"])

    found = F.filter(kind, lambda c: odds(c) > math.log(ACCEPT / (1 - ACCEPT)))
    if kind == "contact":
        clear = lambda c: reduce(lambda a, k: a & ~F.exists(k, lambda x: (x["s"] < c["e"]) & (c["s"] < x["e"])), KINDS, _digits(c["t"]).between(7, 12))
        found = F.when(F.size(kind) > 0, F.filter(found, clear)).otherwise(F.col(kind))
    return found


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """-> doc_id, text (null as empty), the columns ``keep``, and an array of spans (s, e, t, before) for each kind."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)
    model = fit(docs)
    return base_spans(docs, LEARNED).withColumns({k: _accepted(k, model[k]) for k in LEARNED})


def _joined(kinds) -> Column:
    return F.concat_ws(",", *(F.expr(f"transform({k}, x -> concat('{k}:', x.s, ':', x.e))") for k in kinds))


def pii_spans(docs: DataFrame) -> DataFrame:
    """-> doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_contact, base_sha256, spans: one row per input row.

    Null counts as empty; empty texts have no spans. Ids are passed on as they are: rows without one or with one that repeats have
    results of their own. An empty table gives an empty result; other columns are ignored.
    """
    n = {f"n_{k}": F.size(k).cast("long") for k in (*KINDS, *LEARNED)}
    return find(docs).select("doc_id", *(v.alias(k) for k, v in n.items()), F.sha2(_joined(KINDS), 256).alias("base_sha256"), _joined((*KINDS, *LEARNED)).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The same columns, each found span of ``text`` replaced by its kind in brackets; overlapping spans by the first one's."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    all_spans = F.array_sort(F.concat(*(F.expr(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e, 'k', '[{k.upper()}]'))") for k in (*KINDS, *LEARNED))))
    found = find(docs, keep=others).withColumn("all_spans", all_spans)
    clean = F.expr("""case when size(all_spans) = 0 then text else aggregate(all_spans, named_struct('at', 0, 'out', ''),
        (z, x) -> named_struct('at', greatest(z.at, x.e), 'out', if(x.s < z.at, z.out, concat(z.out, substring(text, z.at + 1, x.s - z.at), x.k))),
        z -> concat(z.out, substring(text, z.at + 1))) end""")
    return found.withColumn("text", clean).select(docs.columns)
