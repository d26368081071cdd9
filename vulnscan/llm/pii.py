"""Operator 7 [native]: personal data by weak supervision.

Base: four labelers with fixed patterns and checks (email, ip, card, phone); their
spans are certain. Beyond them, candidate spans (long mixed strings such as keys, also
in short runs joined by hyphens; the token that follows a lead word such as ``password``
and its separator; bracketed or grouped phone numbers and any other 7 to 15 digits with
separators, without a leading plus) are judged by voting labelers: a shape pattern, a
gazetteer of lead words, the context before the span, and a dispersion test of the
characters. The votes of all candidates are counted by
pattern (at most 2^4 patterns a kind), expectation-maximisation over those counts
estimates each labeler's reliability, and the resulting posteriors weigh the
counts from which a final span classifier (naive Bayes over span features) is
trained. A candidate is a span when that classifier says so.

Everything on rows is SQL; the driver sees the vote patterns and the feature
counts, both of fixed size whatever the corpus.

Patterns: linear. Repetitions are possessive, which matches the same strings as
the contract's greedy ones (each class excludes what must follow it) and never
recurses; emails can only start where a run of their characters starts or where
the last match ended.

Defined cases: null and empty texts have no spans; very long texts are scanned
whole, positions by two-level prefix sums; overlapping spans of different kinds
all stay; repeated rows are judged alike; an empty table trains nothing and
gives no rows; other columns are kept by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Base kinds in their order, and the patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot match; spares most texts the pattern.
SCREENS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Gazetteer of lead words, by kind.
GAZETTEER = {
    "secret": ("token", "key", "secret", "password", "passwd", "apikey", "credential", "bearer"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
}
_LEADS = "|".join(GAZETTEER["secret"])
#: A lead word and its separator; what follows is a value, in quotes or up to white space.
_LEAD = rf"(?<![A-Za-z])(?i:{_LEADS})[\"']?[\x20\t]{{0,3}}[=:][\x20\t]{{0,3}}"
_LOCAL = (r"\([0-9]{2,5}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}|[0-9]{3}(?:[\x20./-][0-9]{3})?[\x20./-][0-9]{4}"
          r"|0[0-9]{2,4}[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}")
#: Candidates that the labelers vote on, listed after the base kinds. Alternatives in
#: order: for secrets the quoted value or the token, of any length, after a lead word and
#: its separator, one long run, runs joined by hyphens; for phones a bracketed area code, common groupings, any digits.
CANDIDATES = {
    "secret": rf"(?<=[\"'])(?<={_LEAD}[\"'])[^\"'\r\n]{{4,}}+(?=[\"'])"
              r"|(?<![A-Za-z0-9_])(?<=[=:][\x20\t]{0,3}[\"']?|[rR]\x20)"
              rf"(?<={_LEAD}[\"']?|(?<![A-Za-z])(?i:bearer)\x20)"
              r"[A-Za-z0-9_+/=.~!@#$%^&*:?-]{3,}[A-Za-z0-9_+/=$%&*#-]"
              r"|(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+"
              r"|(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{16})(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_]{1,15}+(?:-[A-Za-z0-9_]{1,15}+)++(?![A-Za-z0-9_-])",
    "local_phone": r"(?<![0-9+(])\([0-9]{2,4}\)\x20?[0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])"
                   rf"|(?<![A-Za-z0-9_+.-])(?:{_LOCAL})(?![A-Za-z0-9_]|[.-][0-9])"
                   r"|(?<![A-Za-z0-9_+])(?<![0-9+][\x20()./-]{1,2})(?![0-9]++(?:\.[0-9]++){3})\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}+(?![A-Za-z0-9_]|[\x20()./-]{1,2}[0-9])",
}
CANDIDATE_SCREENS = {"secret": rf"[0-9]|(?i:{_LEADS})[\"']?[\x20\t]{{0,3}}[=:\x20]", "local_phone": r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}"}
ORDER = {k: i for i, k in enumerate((*KINDS, *CANDIDATES))}
CONTEXT = {"secret": r"(?:[=:]\s*[\"']?|bearer )$", "local_phone": r"(?:[:]|\+[0-9]{1,3})\s*$"}
SECRET_SHAPE = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{12,}|gh[a-z]_[A-Za-z0-9]{20,}|sk_[A-Za-z0-9_]{16,})$"
#: Tokens after a lead word may be short: letters and digits mixed.
SHORT_SECRET_SHAPE = r"^(?=.*[A-Za-z])(?=.*[0-9])\S{6,15}$"
LOCAL_SHAPE = rf"^(?:{_LOCAL})$"
CONTEXT_CHARS = 24
LABELERS = 4
EM_ROUNDS = 50
PRIOR = 0.3
THRESHOLD = 0.5
_MATCHES = "array<struct<start:int,end:int,found:string>>"


def located(text: Column, pattern: str, screen: str) -> Column:
    """Matches, leftmost and not overlapping, each with the gap before it. ``split``
    gives the gaps between the matches, and one more after the last."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gap"))
    steps = F.transform(both, lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.coalesce(F.length(z["found"]), F.lit(0)).alias("len"), z["found"].alias("found")))
    return F.when(text.rlike(screen), steps).otherwise(F.array().cast("array<struct<gap:int,len:int,found:string>>"))


def _block(s: Column) -> Column:
    return F.greatest(F.ceil(F.sqrt(F.size(s))).cast("int"), F.lit(1))


def _total(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x["gap"] + x["len"])


def _block_sums(steps: str) -> Column:
    s = F.col(steps)
    last = F.floor((F.greatest(F.size(s), F.lit(1)) - 1) / _block(s)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda j: _total(F.slice(s, j * _block(s) + 1, _block(s))))


def _sums_before(sums: str) -> Column:
    t = F.col(sums)
    return F.transform(t, lambda _, j: F.aggregate(F.slice(t, F.lit(1), j), F.lit(0), lambda a, x: a + x))


def _positions(steps: str, before: str) -> Column:
    """array<struct<start, end, found>>: a match starts after the blocks before its own,
    the steps before it in its block, and its gap. A text with k matches costs
    k * sqrt(k) additions."""
    s = F.col(steps)

    def placed(x, i):
        j = F.floor(i / _block(s)).cast("int")
        start = F.get(F.col(before), j) + _total(F.slice(s, j * _block(s) + 1, F.pmod(i, _block(s)))) + x["gap"]
        return F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["found"].alias("found"))

    return F.filter(F.transform(s, placed), lambda m: m["found"].isNotNull())


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    at = F.sequence(F.lit(1), F.length(digits))

    def worth(i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = 2 * d
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(at, F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        d = _digits(found)
        return F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _spans(rows: DataFrame, kinds: dict[str, str], screens: dict[str, str]) -> DataFrame:
    """Adds one array column for each kind: structs of start, end, found."""
    text = F.col("_text")
    rows = rows.select("*", *[located(text, p, screens[k]).alias(f"_s_{k}") for k, p in kinds.items()])
    # columns of their own: an expression inside a lambda is evaluated for each element
    rows = rows.select("*", *[_block_sums(f"_s_{k}").alias(f"_t_{k}") for k in kinds])
    rows = rows.select("*", *[_sums_before(f"_t_{k}").alias(f"_p_{k}") for k in kinds])
    rows = rows.select("*", *[_positions(f"_s_{k}", f"_p_{k}").alias(f"_m_{k}") for k in kinds])
    return rows.drop(*[f"_{x}_{k}" for k in kinds for x in "stp"])


def _context(m) -> Column:
    """The lower-cased characters before a match."""
    first = F.greatest(m["start"] - CONTEXT_CHARS, F.lit(0))
    return F.lower(F.substring(F.col("_text"), first + 1, m["start"] - first))


def _voted(kind: str) -> Column:
    """Candidates of one kind with their votes (a bit for each labeler) and features."""
    def made(m):
        before, found = _context(m), m["found"]
        lead = F.regexp_extract(before, r"([a-z]+)[^a-z]*$", 1)
        n = F.length(found)
        n_digits, n_kinds = F.length(_digits(found)), F.size(F.array_distinct(F.split(F.lower(found), "")))
        if kind == "secret":
            shape = found.rlike(SECRET_SHAPE) | found.rlike(SHORT_SECRET_SHAPE)
            dispersed = (n_kinds >= 8) & (n_digits * 5 >= n) & (n_digits * 10 <= n * 9)
        else:
            shape, dispersed = found.rlike(LOCAL_SHAPE), n_kinds >= 6
        votes = (shape, lead.isin(*GAZETTEER[kind]), before.rlike(CONTEXT[kind]), dispersed)
        bits = reduce(lambda a, b: a + b, [F.when(v, 1 << j).otherwise(0) for j, v in enumerate(votes)])
        features = F.array(
            F.concat(F.lit("length:"), F.least(F.floor(n / 8), F.lit(16)).cast("string")),
            F.concat(F.lit("digits:"), F.floor(n_digits * 8 / F.greatest(n, F.lit(1))).cast("string")),
            F.concat(F.lit("kinds:"), F.least(n_kinds, F.lit(20)).cast("string")),
            F.concat(F.lit("lead:"), F.pmod(F.xxhash64(lead), F.lit(64)).cast("string")),
            F.concat(F.lit("last:"), F.pmod(F.xxhash64(F.substring(before, -1, 1)), F.lit(64)).cast("string")))
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                        bits.alias("votes"), features.alias("features"))

    m = F.coalesce(F.col(f"_m_{kind}"), F.array().cast(_MATCHES))
    m = F.filter(m, lambda x: ~F.exists(F.col("_base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return F.transform(m, made)


def candidates(rows: DataFrame) -> DataFrame:
    """Adds ``_c``: candidate spans with votes and features. A candidate inside a base
    span of the row is left to the base."""
    rows = _spans(rows, CANDIDATES, CANDIDATE_SCREENS)
    return rows.select("*", F.concat(*[_voted(k) for k in CANDIDATES]).alias("_c")).drop(*[f"_m_{k}" for k in CANDIDATES])


def _certain(kind: str) -> Column:
    """Matches of a base kind that pass its check."""
    matches = F.coalesce(F.col(f"_m_{kind}"), F.array().cast(_MATCHES))
    return F.transform(F.filter(matches, lambda m: passes(kind, m["found"])), lambda m: F.struct(
        m["start"].alias("start"), F.lit(ORDER[kind]).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def base(docs: DataFrame, text: str, *cols) -> DataFrame:
    """Adds ``_text`` and ``_base``: the certain spans as (start, order, end, kind)."""
    rows = _spans(docs.select(*cols, F.coalesce(F.col(text), F.lit("")).alias("_text")), PATTERNS, SCREENS)
    parts = [_certain(k) for k in KINDS]
    return rows.select("*", F.array_sort(F.concat(*parts)).alias("_base")).drop(*[f"_m_{k}" for k in KINDS])


def reliabilities(patterns: list[tuple[str, int, int]]) -> dict[str, dict]:
    """Expectation-maximisation over vote-pattern counts (kind, votes, count): the
    prior and each labeler's chance to vote on true and on false candidates."""
    out = {}
    for kind in CANDIDATES:
        rows = [(v, c) for k, v, c in patterns if k == kind]
        prior, hit, miss = PRIOR, [0.8] * LABELERS, [0.1] * LABELERS
        for _ in range(EM_ROUNDS if rows else 0):
            post = [(v, c, _posterior(v, prior, hit, miss)) for v, c in rows]
            yes, no = sum(c * p for _, c, p in post), sum(c * (1 - p) for _, c, p in post)
            prior = (yes + 1) / (yes + no + 2)
            for j in range(LABELERS):  # priors of one vote keep every chance inside (0, 1)
                hit[j] = (sum(c * p for v, c, p in post if v >> j & 1) + 0.8) / (yes + 1)
                miss[j] = (sum(c * (1 - p) for v, c, p in post if v >> j & 1) + 0.1) / (no + 1)
        out[kind] = {"prior": prior, "hit": hit, "miss": miss}
    return out


def _posterior(votes: int, prior: float, hit, miss) -> float:
    yes, no = math.log(prior), math.log(1 - prior)
    for j in range(LABELERS):
        on = votes >> j & 1
        yes += math.log(hit[j] if on else 1 - hit[j])
        no += math.log(miss[j] if on else 1 - miss[j])
    return 1 / (1 + math.exp(min(700, no - yes)))


def train(docs: DataFrame, text: str = "text") -> dict:
    """The span classifier: for each kind a bias and a weight for each feature value
    (all of a fixed range)."""
    # outer: a plain explode adds a filter on its array, for which Spark repeats the patterns
    rows = candidates(base(docs, text)).select(F.explode_outer("_c").alias("c")).filter("c is not null")
    rows = rows.select("c.kind", "c.votes", F.explode_outer("c.features").alias("feature"))
    counted = rows.groupBy("kind", "votes", "feature").count()
    counted = [tuple(r) for r in counted.collect()]  # kinds x 2^4 patterns x fewer than 300 feature values
    patterns: dict[tuple[str, int], int] = {}
    for kind, votes, feature, n in counted:
        if feature.startswith("length:"):  # each candidate has exactly one
            patterns[kind, votes] = patterns.get((kind, votes), 0) + n
    skills = reliabilities([(k, v, n) for (k, v), n in patterns.items()])
    model = {}
    for kind, skill in skills.items():
        soft: dict[str, list[float]] = {}
        yes = no = 0.0
        for k, votes, feature, n in counted:
            if k == kind:
                p = _posterior(votes, skill["prior"], skill["hit"], skill["miss"])
                at = soft.setdefault(feature, [0.0, 0.0])
                at[0] += n * p
                at[1] += n * (1 - p)
                if feature.startswith("length:"):
                    yes, no = yes + n * p, no + n * (1 - p)
        bias = math.log((yes + 1) / (no + 1))
        weights = {f: math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1)) for f, (a, b) in soft.items()}
        votes = {v: _posterior(v, skill["prior"], skill["hit"], skill["miss"]) for v in range(1 << LABELERS)}
        model[kind] = {"bias": bias, "weights": weights, "votes": votes, "skill": skill}
    return model


def _positive(kind: str, m: dict) -> Column:
    prior = F.array(*[F.lit(math.log(max(m["votes"][v], 1e-9) / max(1 - m["votes"][v], 1e-9))) for v in range(1 << LABELERS)])
    names = list(m["weights"]) or ["none"]
    table = F.create_map(*[F.lit(x) for f in names for x in (f, m["weights"].get(f, 0.0))])
    limit = math.log(THRESHOLD / (1 - THRESHOLD))

    def odds(c):
        seen = F.aggregate(c["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        # features are not independent: their mean, not their sum, moves the prior
        return F.get(prior, c["votes"]) + seen / F.size(c["features"])

    return F.filter("_c", lambda c: (c["kind"] == kind) & (odds(c) > limit))


def _accepted(model: dict) -> Column:
    """Candidates of ``_c`` whose log odds by the span classifier, with the votes'
    posterior as its prior, are positive."""
    kinds = [_positive(kind, m) for kind, m in model.items()]
    kept = F.concat(*kinds)
    return F.transform(kept, lambda c: F.struct(
        c["start"].alias("start"),
        F.when(c["kind"] == "secret", ORDER["secret"]).otherwise(ORDER["local_phone"]).alias("order"),
        c["end"].alias("end"), c["kind"].alias("kind")))


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: dict | None = None) -> DataFrame:
    """Columns of ``keep``, then ``_text``, ``_base`` and ``_all``: spans as sorted arrays
    of (start, order, end, kind)."""
    model = train(docs, text) if model is None else model
    rows = candidates(base(docs, text, *keep))
    return rows.select(*keep, "_text", "_base", F.array_sort(F.concat("_base", _accepted(model))).alias("_all"))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", model: dict | None = None) -> DataFrame:
    """The documents with every span's characters replaced by ``[KIND]``; overlapping
    spans are replaced as one, by the first one's kind. Null texts stay null."""
    held = {c: f"_keep_{i}" for i, c in enumerate(docs.columns)}
    rows = find(docs.select(*[F.col(f"`{c}`").alias(h) for c, h in held.items()]), held[text], tuple(held.values()), model)
    rows = rows.withColumn("_u", _united("_all"))
    pieces = F.transform("_u", lambda s, i: F.concat(
        F.substring(F.col("_text"), _end_before(i) + 1, s["start"] - _end_before(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    rest = F.substring(F.col("_text"), F.get(F.col("_u"), F.size("_u") - 1)["end"] + 1, F.length("_text"))
    new = F.when(F.size("_u") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(held[text]))
    return rows.select(*[(new if c == text else F.col(h)).alias(c) for c, h in held.items()])


def _end_before(i) -> Column:
    return F.coalesce(F.get(F.col("_u"), i - 1)["end"], F.lit(0))


def _united(spans: str) -> Column:
    """Overlapping spans as one: a span that starts before an earlier one ends joins it."""
    def step(acc, s):
        last = F.get(acc, F.size(acc) - 1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (s["start"] < F.coalesce(last["end"], F.lit(0))),
                      F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(own)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int,kind:string>>"), step)


def query(spark, sf_dir: str) -> DataFrame:
    rows = find(C.documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_all").alias("spans"))
