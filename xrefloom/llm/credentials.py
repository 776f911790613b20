"""Secret scan by multipart credential linking, with DataFrame functions only.

Each text is read once and leaves the places of its parts, in code points: the base kinds (assignments to secret names,
access identifiers, long hexadecimal runs), which always count, and weak candidates (user names, pass phrases, long mixed
runs, endpoints), which count only where they complete a credential. A part is an identifier, a secret or an endpoint.

Weak candidates are linked by an interval join: parts meet the scopes (paragraphs, cut at blank lines) that hold them, on the
text's key and a block of places with the paragraph's range as the rest of the condition; in a scope, windows of twice
`reach` code points, one every `reach`, count the roles that they hold. Where a secret stands with an identifier or an
endpoint, the window's weak candidates are reported. No pairs of parts are made: a part meets one scope and two windows.

Only texts with a weak candidate and both roles take part in the join, once for all copies of a text; all other rows never
leave the task that read them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text


def either_case(words: str) -> str:
    """A pattern's ASCII letters in either case, whatever the engine folds besides."""
    return "".join(f"[{c}{c.upper()}]" if c.isascii() and c.islower() else c for c in words)


def assigned(names: str, value: str) -> str:
    return f"({either_case(names)})[\"']?\\x20*[:=]\\x20*[\"']?({value})"


@dataclass(frozen=True)
class Kind:
    """name, role, pattern; least: characters of the group of that number; weak: counts only beside others; other: matches of this pattern don't count; hint: strings of which a text with a match has one."""

    name: str
    role: str
    pattern: str
    group: int = 0
    least: int = 0
    weak: bool = False
    other: str = ""
    hint: tuple[str, ...] = ()


# The base kinds, in the order in which spans of one start are listed.
KINDS = (
    Kind("assign", "secret", assigned("password|passwd|secret|token|api_?key", "[A-Za-z0-9+/_.=-]+"), 2, 6, hint=(":", "=")),
    Kind("access", "identifier", "AKIA[A-Z0-9]+", 0, 20, hint=("AKIA",)),
    Kind("hex", "secret", "[0-9a-f]{24,}"),  # the runs of 24 and more among [0-9a-f]+
    Kind("user", "identifier", assigned("user|user_?name|login|account|client_id|key_id|account_?name", "[A-Za-z0-9@._-]+"), 2, 3, True, hint=(":", "=")),
    Kind("pass", "secret", assigned("pwd|pass|passphrase|credentials?|auth|bearer", "[!-&(-~]+"), 2, 6, True, hint=(":", "=")),
    Kind("host", "endpoint", "[a-z][a-z0-9+.-]*://[!#-&(-;=?-~]+|" + assigned("host|host_?name|server|endpoint", "[A-Za-z0-9.-]+"), 0, 8, True, hint=(":", "=")),
    Kind("blob", "secret", "[A-Za-z0-9+/]{32,}", 0, 32, True, "^[0-9a-f]+$"),
)
BLANK_LINE = "\\n[\\x20\\t\\r]*\\n"
#: Parts of a text are summed up in slices of this many, so that long lists are not copied for each part.
SLICE = 512
#: Scopes are kept in blocks of this many code points (as a power of two).
BLOCK = 10
SPAN = "struct<start:int,kind:int,end:int>"


def places(text: Column, pattern: str, ok, kind: int) -> Column:
    """(start, kind, end) of a pattern's leftmost matches that do not overlap, in code points, where ok(match) holds."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(matches))
    steps = F.zip_with(matches, gaps, lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), ok(m).alias("ok")))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / SLICE).cast("int")), lambda k: F.slice(steps, k * SLICE + 1, F.lit(SLICE)))
    sizes = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x["gap"] + x["n"]))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))

    def within(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast(f"array<struct<start:int,kind:int,end:int,ok:boolean>>").alias("out"))

        def add(a: Column, x: Column) -> Column:
            at = a["at"] + x["gap"]
            return F.struct((at + x["n"]).alias("at"), F.array_append(a["out"], F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + x["n"]).alias("end"), x["ok"].alias("ok"))).alias("out"))

        return F.aggregate(part, first, add, lambda a: a["out"])

    every = F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), within))
    good = F.transform(F.filter(every, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.when(F.size(matches) > 0, good)


def found(text: Column, number: int, kinds: tuple[Kind, ...]) -> Column:
    """The places of one kind; an empty list where a text has none."""
    kind = kinds[number]

    def ok(m: Column) -> Column:
        out = F.length(F.regexp_extract(m, f"^(?:{kind.pattern})", kind.group) if kind.group else m) >= kind.least
        return out & ~F.rlike(m, F.lit(kind.other)) if kind.other else out

    may = F.rlike(text, F.lit(kind.pattern))
    for k, hint in enumerate(kind.hint):
        has = F.contains(text, F.lit(hint)) if k == 0 else has | F.contains(text, F.lit(hint))
    may = has & may if kind.hint else may
    return F.coalesce(F.when(may, places(text, kind.pattern, ok, number)), F.array().cast(f"array<{SPAN}>"))


def paragraphs(text: Column) -> Column:
    """(start, end) of a text's paragraphs, each with the blank line after it."""
    ends = F.coalesce(places(text, BLANK_LINE, lambda m: F.lit(True), 0), F.array().cast(f"array<{SPAN}>"))
    cuts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x["end"]))
    return F.zip_with(cuts, F.concat(F.slice(cuts, F.lit(2), F.size(cuts)), F.array(F.length(text) + 1)), lambda a, b: F.struct(a.alias("first"), b.alias("next")))


def linked(texts: DataFrame, kinds: tuple[Kind, ...], reach: int) -> DataFrame:
    """Of distinct texts (k0, k1, parts, scopes): the weak candidates that complete a credential, as a list `more` for each text that has one."""
    is_secret = F.col("kind").isin([n for n, k in enumerate(kinds) if k.role == "secret"])
    is_weak = F.col("kind").isin([n for n, k in enumerate(kinds) if k.weak])
    parts = texts.select("k0", "k1", F.inline("parts")).withColumn("block", F.shiftright("start", BLOCK))
    scopes = texts.select("k0", "k1", F.inline("scopes"))
    scopes = scopes.withColumn("block", F.explode(F.sequence(F.shiftright("first", BLOCK), F.shiftright(F.col("next") - 1, BLOCK))))
    met = parts.join(scopes, ["k0", "k1", "block"]).filter("start >= first and start < next")
    step = F.floor((F.col("start") - F.col("first")) / reach)
    windows = met.withColumn("window", F.explode(F.array(step - 1, step)))
    # a window's weak candidates are no more than fit into its characters
    both = windows.groupBy("k0", "k1", "first", "window").agg(F.max(is_secret).alias("secret"), F.max(~is_secret).alias("other"), F.collect_list(F.when(is_weak, F.struct("start", "kind", "end"))).alias("weak"))
    return both.filter("secret and other").select("k0", "k1", F.explode("weak").alias("span")).groupBy("k0", "k1").agg(F.collect_set("span").alias("more"))


def written(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    """kind:start:end of spans, by start and then kind, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in kinds))
    one = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), kinds: tuple[Kind, ...] = KINDS, reach: int = 400) -> DataFrame:
    """For every row: the columns of keep, the base spans and those of linked weak candidates, each (start, kind, end) with the kind's number.

    A null text is empty and has none. Repeated rows have equal results, each row its own. reach: parts at most so many
    code points apart within a paragraph are linked, parts twice as far apart or in two paragraphs never are.
    """
    names = [f"_own{k}" for k in range(len(keep))]
    rows = docs.select(*keep, whole_text(text)).toDF(*names, "text")
    base = [n for n, k in enumerate(kinds) if not k.weak]
    early = [n for n, k in enumerate(kinds) if k.weak and k.hint]
    late = [n for n, k in enumerate(kinds) if k.weak and not k.hint]
    none = F.array().cast(f"array<{SPAN}>")
    read = rows.select(*names, "text", *(found(F.col("text"), n, kinds).alias(f"_s{n}") for n in base + early))
    count = lambda which: sum((F.size(f"_s{n}") for n in which), F.lit(0))
    of = lambda role, which: [n for n in which if (kinds[n].role == "secret") == role]
    # long mixed runs are looked for only where an identifier or endpoint stands; a text takes part in the join with a weak candidate and both roles
    read = read.select("*", *(F.when(count(of(False, base + early)) > 0, found(F.col("text"), n, kinds)).otherwise(none).alias(f"_s{n}") for n in late))
    read = read.withColumn("_may", (count(early + late) > 0) & (count(of(True, base + early + late)) > 0) & (count(of(False, base + early)) > 0))
    listed = lambda which: F.concat(*(F.col(f"_s{n}") for n in which))
    read = saved(
        read.select(*names, listed(base).alias("base"), F.when(F.col("_may"), listed(base + early + late)).alias("parts"), F.when(F.col("_may"), paragraphs(F.col("text"))).alias("scopes"), F.when(F.col("_may"), F.xxhash64("text")).alias("k0"), F.when(F.col("_may"), F.xxhash64(F.lit(1), "text")).alias("k1"))
    )
    some = read.filter("k0 is not null")
    more = linked(some.groupBy("k0", "k1").agg(F.first("parts").alias("parts"), F.first("scopes").alias("scopes")), kinds, reach)
    ends = some.join(more, ["k0", "k1"], "left").select(*names, "base", F.coalesce("more", none).alias("linked"))
    out = read.filter("k0 is null").select(*names, "base", none.alias("linked")).unionByName(ends)
    return out.select(*(F.col(c).alias(k) for c, k in zip(names, keep, strict=True)), "base", "linked")


def digests(scanned: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The contract's columns from a scan: counts of the base kinds, the hash of the base spans and all spans as text."""
    of = lambda n: F.size(F.filter("base", lambda x: x["kind"] == n)).cast("long")
    own = [c for c in scanned.columns if c not in ("base", "linked")]
    counts = [of(n).alias(f"n_{k.name}") for n, k in enumerate(kinds) if not k.weak]
    return scanned.select(*own, *counts, F.sha2(written(F.col("base"), kinds), 256).alias("base_sha256"), written(F.concat("base", "linked"), kinds).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


def duckdb_sql(kinds: tuple[Kind, ...] = KINDS, reach: int = 400) -> str:
    """The same scan and digests of the table documents in DuckDB."""
    q = lambda s: "'" + s.replace("'", "''").replace("\\x20", " ") + "'"
    parts = []
    for n, k in enumerate(kinds):
        value = f"regexp_extract(m, {q(k.pattern)}, {k.group})" if k.group else "m"
        other = f" AND NOT regexp_matches(m, {q(k.other)})" if k.other else ""
        parts.append(f"""SELECT rn, {n} AS kind, CAST(e - length(m) AS INT) AS s, CAST(e AS INT) AS e FROM (
    SELECT rn, m, sum(length(g) + length(m)) OVER (PARTITION BY rn ORDER BY i) AS e FROM (
      SELECT rn, unnest(ms) AS m, unnest(list_slice(gs, 1, len(ms))) AS g, unnest(range(len(ms))) AS i FROM (
        SELECT rn, regexp_extract_all(text, {q(k.pattern)}) AS ms, string_split_regex(text, {q(k.pattern)}) AS gs FROM texts))) WHERE length({value}) >= {k.least}{other}""")
    weak = ", ".join(str(n) for n, k in enumerate(kinds) if k.weak)
    secret = ", ".join(str(n) for n, k in enumerate(kinds) if k.role == "secret")
    name = "CASE kind " + " ".join(f"WHEN {n} THEN '{k.name}'" for n, k in enumerate(kinds)) + " END"
    text = f"string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    blank = "chr(10) || '[ \\t\\r]*' || chr(10)"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({" UNION ALL ".join(parts)}),
cuts AS (SELECT rn, 0 AS first FROM texts UNION ALL SELECT rn, sum(length(g) + length(m)) OVER (PARTITION BY rn ORDER BY i) FROM (
  SELECT rn, unnest(ms) AS m, unnest(list_slice(gs, 1, len(ms))) AS g, unnest(range(len(ms))) AS i FROM (SELECT rn, regexp_extract_all(text, {blank}) AS ms, string_split_regex(text, {blank}) AS gs FROM texts))),
placed AS (SELECT p.*, max(c.first) AS first FROM parts p JOIN cuts c ON p.rn = c.rn AND c.first <= p.s GROUP BY ALL),
wide AS (SELECT *, unnest([(s - first) // {reach} - 1, (s - first) // {reach}]) AS w FROM placed),
good AS (SELECT rn, first, w FROM wide GROUP BY ALL HAVING bool_or(kind IN ({secret})) AND bool_or(kind NOT IN ({secret}))),
linked AS (SELECT DISTINCT rn, kind, s, e FROM wide JOIN good USING (rn, first, w) WHERE kind IN ({weak})),
base AS (SELECT rn, kind, s, e FROM parts WHERE kind NOT IN ({weak})),
b AS (SELECT rn, {", ".join(f"count(*) FILTER (kind = {n}) AS n_{k.name}" for n, k in enumerate(kinds) if not k.weak)}, {text} AS base FROM base GROUP BY rn),
a AS (SELECT rn, {text} AS spans FROM (SELECT * FROM base UNION ALL SELECT rn, kind, s, e FROM linked) GROUP BY rn),
l AS (SELECT rn, count(*) AS n_linked FROM linked GROUP BY rn)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in kinds if not k.weak)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM texts LEFT JOIN b USING (rn) LEFT JOIN a USING (rn) LEFT JOIN l USING (rn)"""
