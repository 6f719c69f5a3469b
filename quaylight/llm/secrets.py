"""Secret scans: base patterns, and weak candidates linked by an interval join.

Every whole text is searched with one pattern a kind. A kind has a role (identifier, secret or
endpoint) and is strong (the base patterns) or weak. Strong matches are always reported. Weak
parts are reported only where complementary parts lie in the same scope: the same text, at most
SCOPE code points from the end of one to the start of the other. A weak secret needs an identifier
or an endpoint, a weak identifier needs a secret, an endpoint needs both.

Only DataFrame functions run: matches leave a text as (kind, number, gap, match) parts, so the text
itself is never shuffled; running sums of gaps and matches give code-point positions; the running
furthest end and first start of each role are the interval join (no pair is ever emitted). Copies
of a row (same id and text) are counted before the shuffle, so a third of all rows being one row
sends a row for each input task. That one shuffle on the row's key serves all further steps. A
kind's pattern runs only over texts that hold one of its words.

Every repeated group of a pattern is possessive and its names are bounded (PARTS names of at most
PART letters around a keyword, longer ones are no credential names), so a match neither recurses
nor looks further than a fixed way from its keyword: work per text follows its length.

OP1_SQL has the narrower weak patterns (no names around a keyword) and compares starts, so it
reports a subset where texts hold such parts; tests hold the wide ones to a plain search.

A span covers the whole match: start and end in code points, end exclusive.

Defined results: a null text is empty and has no spans; a row without matches keeps its row;
repeated rows (same id and text) are repeated in the result; an empty table gives an empty result.
Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SCOPE = 240
VALUE = "[A-Za-z0-9+/_.=-]"
SET = "[\"']?\\x20*[:=]\\x20*[\"']?"
#: kind: (role, strong, pattern, least length of `group`, group). Fixed order: the order of spans with equal starts.
KINDS = {
    "assign": ("secret", True, f"(?i)(password|passwd|secret|token|api_?key){SET}({VALUE}+)", 12, 2),
    "access": ("identifier", True, "AKIA[A-Z0-9]{14,}", 18, 0),
    "hex": ("secret", True, "[0-9a-f]{16,}", 16, 0),
    "weak_secret": ("secret", False, f"(?i)\\b(passphrase|pass|pwd|auth|credential|password|passwd|secret|token|api_?key){SET}({VALUE}{{6,}})", 6, 2),
    "weak_identifier": ("identifier", False, "(?i)\\b(user_?name|user|login|client_?id|account|access_?key(?:_?id)?)" + SET + "([A-Za-z0-9@._-]{3,})", 3, 2),
    "endpoint": ("endpoint", False, "(?i)\\b(?:[a-z][a-z0-9+.-]{1,20}://[^\\s\"'<>]+|(?:host|endpoint|server)" + SET + "[a-z0-9.-]{4,})", 4, 0),
}
STRONG = [k for k, v in KINDS.items() if v[1]]
#: A keyword may follow '_', '-', '.', a digit or a capital's edge (DB_PASSWORD, dbPassword), and more names may follow it (secret_access_key).
EDGE = "(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))"
#: Names after a keyword: at most PARTS of at most PART letters and digits.
PARTS, PART = 12, 40
#: One that tells of another role ends the keyword's claim (auth_user, user_password). Possessive, as nothing that may follow is a letter.
MORE = "[0-9]{{0,20}}+(?:(?:[_.-]|(?-i:(?<=[a-z])(?=[A-Z])))(?!{})[A-Za-z0-9]{{1,%d}}+){{0,%d}}+" % (PART, PARTS)
MORE_SECRET = MORE.format("user|login|account|client|name|id(?![a-z])|host|server|endpoint|url|uri")
MORE_IDENTIFIER = MORE.format("pass|pwd|auth|cred|secret|token|(?:api|access|secret)?[_.-]?key(?![_.-]?id)|host|server|endpoint|url|uri")
#: What is searched. KINDS stay as the SQL has them.
WIDE = KINDS | {
    "weak_secret": ("secret", False, f"(?i){EDGE}(passphrase|pass|pwd|auth|credential|password|passwd|secret|token|api_?key){MORE_SECRET}{SET}({VALUE}{{6,}})", 6, 2),
    "weak_identifier": ("identifier", False, f"(?i){EDGE}(?<!(?:secret|api)[_.-]?)(user_?name|user|login|client_?id|account|access_?key(?:_?id)?){MORE_IDENTIFIER}{SET}([A-Za-z0-9@._-]{{3,}})", 3, 2),
    # What counts as a letter in \\b differs between Java versions and engines.
    "endpoint": (*KINDS["endpoint"][:2], KINDS["endpoint"][2].replace("\\b", "(?<![A-Za-z0-9_])"), *KINDS["endpoint"][3:]),
}
#: Some of these words, in either case, is in every match of a kind.
WORDS = {
    "assign": ["passw", "secret", "token", "api"],
    "access": ["akia"],
    "hex": [],
    "weak_secret": ["pass", "pwd", "auth", "credential", "secret", "token", "api"],
    "weak_identifier": ["user", "login", "client", "account", "access"],
    "endpoint": ["://", "host", "endpoint", "server"],
}


def found(text: Column, kind: str) -> Column:
    """Matches of a kind in order, each with the length of the text between it and the one before."""
    pattern = F.lit(WIDE[kind][2])
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, WIDE[kind][2], -1)
    held = [F.lower(text).contains(w) for w in WORDS[kind]]
    matches = reduce(lambda a, b: a | b, held) & text.rlike(WIDE[kind][2]) if held else text.rlike(WIDE[kind][2])
    rows = F.transform(
        hits,
        lambda m, i: F.struct(F.lit(list(KINDS).index(kind)).alias("k"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), m.alias("match")),
    )
    return F.when(matches, rows).otherwise(F.array().cast("array<struct<k:int,i:int,gap:int,match:string>>"))


def long_enough(k: Column, match: Column) -> Column:
    """Whether the asked group has its least length; weak assignments that the base reports are no parts of their own."""
    tests = F.lit(True)
    for n, (kind, (_, _, pattern, least, group)) in enumerate(WIDE.items()):
        if group:
            value = F.length(F.regexp_extract(match, pattern, group))
            keep = value >= least
            if kind == "weak_secret":
                keep = keep & ((value < KINDS["assign"][3]) | ~match.rlike(KINDS["assign"][2]))
            tests = F.when(k == n, keep).otherwise(tests)
    return tests


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash, and an ordered array of spans (start, k, kind, end, strong) for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.concat(*[found(F.col("_t"), kind) for kind in KINDS])
    key = ["doc_id", "text_hash"]
    rows = (
        docs.select("doc_id", text.alias("_t"))
        .select("doc_id", F.xxhash64("_t").alias("text_hash"), parts.alias("_p"))
        .groupBy(*key)
        .agg(F.first("_p").alias("_p"), F.count("*").alias("_copies"))
        .select(*key, "_copies", F.explode_outer("_p").alias("_p"))
        .select(*key, "_copies", "_p.*")
    )
    so_far = Window.partitionBy(*key, "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    placed = placed.withColumn("_use", F.coalesce(long_enough(F.col("k"), F.col("match")), F.lit(False)))
    role = F.element_at(F.array(*[F.lit(v[0]) for v in KINDS.values()]), F.col("k") + 1)
    strong = F.element_at(F.array(*[F.lit(v[1]) for v in KINDS.values()]), F.col("k") + 1)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    # A part's gap to those that start before it is known from their furthest end, to those after it from their first start.
    before = Window.partitionBy(*key).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*key).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda r, x: F.when(F.col("_use") & (role == r), F.col(x))
    roles = {"_s": "secret", "_i": "identifier", "_e": "endpoint"}
    ends = placed.withColumns({f"{n}b": F.max(of(r, "end")).over(before) for n, r in roles.items()} | {f"{n}a": F.min(of(r, "start")).over(after) for n, r in roles.items()})
    reached = lambda n: F.coalesce(F.col(f"{n}b") + SCOPE >= F.col("start"), F.lit(False)) | F.coalesce(F.col(f"{n}a") <= F.col("end") + SCOPE, F.lit(False))
    linked = ends.withColumns({n: reached(n) for n in roles})
    report = F.col("_use") & (
        strong
        | ((role == "secret") & (F.col("_i") | F.col("_e")))
        | ((role == "identifier") & F.col("_s"))
        | ((role == "endpoint") & F.col("_s") & F.col("_i"))
    )
    span = F.struct("start", "k", kind.alias("kind"), "end", strong.alias("strong"))
    return (
        linked.groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.when(report, span))).alias("spans"), F.max("_copies").alias("copies"))
    )


def joined(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id",
        *[count(k) for k in STRONG],
        F.sha2(joined(F.filter("spans", lambda s: s["strong"])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by mask and n_chars brought up to date; all rows and columns stay.

    Rows with spans meet them by (doc_id, text hash) in a sort-merge join; keys are unique on the
    spans' side.
    """
    got = spans(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("_secret_id"), F.col("text_hash").alias("_secret_hash"), F.col("spans").alias("_secret_spans"))
    keyed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = keyed.join(got.hint("merge"), keyed["doc_id"].eqNullSafe(got["_secret_id"]) & (keyed["_text_hash"] == got["_secret_hash"]), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.col("text").substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.when(fresh, F.concat(acc["out"], before, F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    done = F.aggregate("_secret_spans", start, step)
    masked = F.concat(done["out"], F.col("text").substr((done["at"] + 1).cast("int"), F.length("text")))
    text = F.when(F.col("_secret_spans").isNull(), F.col("text")).otherwise(masked)
    changed = both.withColumn("text", text).withColumn("n_chars", F.when(F.col("_secret_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return changed.select(*docs.columns)


def _sql() -> str:
    """op1_secrets for DuckDB: the same patterns, sums and range frames."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts, least, roles, strong, names = [], [], [], [], []
    for n, (kind, (role, sure, pattern, size, group)) in enumerate(KINDS.items()):
        hits = f"regexp_extract_all(t, {quoted(pattern)})"
        parts.append(f"select rid, {n} as k, unnest(range(len({hits}))) as i, unnest({hits}) as m, unnest(string_split_regex(t, {quoted(pattern)})[1:len({hits})]) as gap from d")
        value = f"length(regexp_extract(m, {quoted(pattern)}, {group}))"
        test = f"{value} >= {size}" if group else "true"
        if kind == "weak_secret":
            test += f" and ({value} < {KINDS['assign'][3]} or not regexp_matches(m, {quoted(KINDS['assign'][2])}))"
        least.append(f"when {n} then {test}")
        roles.append(quoted(role))
        strong.append("true" if sure else "false")
        names.append(quoted(kind))
    near = lambda role: f"bool_or(used and role = '{role}') over (partition by rid order by start range between {SCOPE} preceding and {SCOPE} following)"
    text = "kind || ':' || start || ':' || stop"
    count = lambda kind: f"coalesce(count(*) filter (kind = '{kind}' and report), 0) as n_{kind}"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
p as ({" union all ".join(parts)}),
q as (select *, sum(length(gap) + length(m)) over (partition by rid, k order by i)::bigint as stop, case k {" ".join(least)} end as used from p where m is not null),
r as (select *, stop - length(m) as start, [{", ".join(roles)}][k + 1] as role, [{", ".join(strong)}][k + 1] as strong, [{", ".join(names)}][k + 1] as kind from q),
s as (select *, {near("secret")} as s, {near("identifier")} as i2, {near("endpoint")} as e from r),
u as (select *, used and (strong or (role = 'secret' and (i2 or e)) or (role = 'identifier' and s) or (role = 'endpoint' and s and i2)) as report from s),
a as (select rid, {", ".join(count(k) for k in STRONG)}, coalesce(string_agg({text}, ',' order by start, k) filter (report and strong), '') as base, coalesce(string_agg({text}, ',' order by start, k) filter (report), '') as spans from u group by rid)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in STRONG)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (rid)
"""


OP1_SQL = _sql()
