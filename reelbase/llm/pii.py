"""Personal data by weak supervision, in DataFrame and SQL functions only.

Patterns give candidate spans. Base rules keep those that are personal data by their form alone. Every candidate is
also voted on (-1, 0, 1) by labelers: the strict pattern, a gazetteer (top-level domains, calling codes, card
prefixes, account countries), words of the context, a structure check and the characters around it. Expectation
maximisation over the counts of vote patterns (a table of bounded size) estimates each labeler's reliability for
each kind; its posteriors train a logistic span classifier, again over counts. The classifier's spans are added where
they don't touch base spans. Only the classifier's weights (a dozen numbers) travel through the driver.

Work on a text is close to linear in its length and matches: sums and maxima over what comes before a match are made
in blocks of about the square root of the matches' number, and texts are rebuilt from chunks.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, staged

#: Kinds in the order of all digests; base rules exist for the first four, the others come from the method.
KINDS = ("email", "ip", "card", "phone", "account")

#: Candidate patterns. Runs are entered at their first character only ("\G" or a character from outside before it) and
#: quantifiers don't backtrack, so scanning is linear; matches are the same as without either.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates that only the method can add, by kind.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}\x20?(?:(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]{2,63})+",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z.-])",
    "account": r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9-])",
}
#: A text without this has no candidate of the kind.
GUARD = {"email": "@", "phone": r"+"}
GUARD_LOOSE = {"email": r"[\[(]at[\])]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}", "account": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}"}

# The labelers' gazetteers and words.
DOMAINS = "com|org|net|edu|gov|int|info|biz|io|de|fr|es|it|uk|eu|ch|at|nl|be|us|ca|au|jp|cn|in|br|mx|ru|pl|se|no|dk|fi|pt|ie"
COUNTRIES = "AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK"
WORDS = {
    "email": "mail|contact|contacto|correo|kontakt|write|reach|courriel",
    "ip": r"\bip\b|addr|host|server|login|adresse|servidor",
    "card": "card|visa|master|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|tel\b|tel\.|call|fax|mobile|telefon|appel|llamar",
    "account": "iban|account|konto|compte|cuenta|ssn|social security",
}
LABELERS = ("strict", "gazetteer", "context", "structure", "edges")
VOTES = (-1, 0, 1)

#: A match: its start, text, what comes before it (the last 32 characters of the last match and what lies between), and the character after.
MATCH = "array<struct<start:bigint,m:string,before:string,after:string>>"
#: Characters of a chunk of a text that is rebuilt.
CHUNK = 2048


def q(pattern: str) -> str:
    """A pattern as a raw SQL string literal."""
    assert "'" not in pattern and '"' not in pattern
    return f"r'{pattern}'"


def let(value: str, name: str, body: str) -> str:
    """SQL: body, with value computed once as name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def before_each(xs: str, start: str, step: str) -> str:
    """SQL: for each of a filled array of bigints what step (of s and v) makes of start and the numbers before it."""
    fold = lambda of, first: f"aggregate({of}, {first}, (s, v) -> {step})"
    inside = f"transform(blk, (v0, i0) -> {fold('slice(blk, 1, i0)', 'base0')})"
    blocks = f"flatten(transform(blks, (blk, k0) -> {let(fold('slice(sums, 1, k0)', start), 'base0', inside)}))"
    blocks = let(f"transform(blks, y -> {fold('y', start)})", "sums", blocks)
    blocks = let("transform(sequence(0, (size(xs0) - 1) div b0), k -> slice(xs0, int(k * b0 + 1), b0))", "blks", blocks)
    return let(xs, "xs0", let("greatest(int(sqrt(size(xs0))), 1)", "b0", blocks))


def found(pattern: str, guard: str | None, regex_guard: bool = False) -> str:
    """SQL: all matches in column t."""
    starts = before_each("transform(ms, (m, i) -> cast(length(get(ps, i)) + length(m) as bigint))", "0L", "s + v")
    before = "right(concat(coalesce(get(ps, i - 1), ''), coalesce(get(ms, i - 1), ''), get(ps, i)), 32)"
    after = "left(concat(get(ps, i + 1), coalesce(get(ms, i + 1), '')), 1)"
    each = f"transform(ms, (m, i) -> named_struct('start', get(at, i) + length(get(ps, i)), 'm', m, 'before', {before}, 'after', {after}))"
    out = let(f"split(t, {q(pattern)}, -1)", "ps", let(f"regexp_extract_all(t, {q(pattern)}, 0)", "ms", f"if(size(ms) = 0, cast(array() as {MATCH}), {let(starts, 'at', each)})"))
    test = f"t rlike {q(guard)}" if regex_guard else f"contains(t, '{guard}')" if guard else f"t rlike {q(pattern)}"
    return f"CASE WHEN {test} THEN {out} ELSE cast(array() as {MATCH}) END"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(m: str) -> str:
    """SQL: the digits of m pass the Luhn check."""
    d = "(ascii(c) - 48)"
    return f"aggregate(transform(split(reverse({digits(m)}), ''), (c, i) -> if(c = '', 0, if(i % 2 = 1, if({d} > 4, {d} * 2 - 9, {d} * 2), {d}))), 0, (a, v) -> a + v) % 10 = 0"


def base_rule(kind: str, m: str) -> str:
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"forall(split({m}, r'\\.'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)"
    n = f"length({digits(m)})"
    if kind == "card":
        return f"({n} BETWEEN 16 AND 19 AND {luhn(m)})"
    return f"({n} BETWEEN 8 AND 15)"


def votes(kind: str, strict: str, m: str, before: str, after: str) -> str:
    """SQL: the labelers' votes, as a list of fields for named_struct."""
    two = lambda c: f"if({c}, 1, -1)"
    maybe = lambda c: f"if({c}, 1, 0)"
    n = f"length({digits(m)})"
    gazetteer = {
        "email": two(f"lower({m}) rlike r'[.\\x20)\\]](?:{DOMAINS})$'"),
        "ip": two(f"NOT {m} rlike r'^(?:0|127|22[4-9]|2[3-9][0-9])\\.'"),
        "card": two(f"{digits(m)} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6)'"),
        "phone": f"if({m} rlike r'^\\+(?:1|2[07]|3|4|5|6|7|8|9)', 1, 0)",
        "account": two(f"{m} rlike '^(?:{COUNTRIES}|[0-9])'"),
    }[kind]
    structure = {
        "email": two(f"length({m}) <= 254 AND NOT {m} rlike r'\\.\\.'"),
        "ip": two(f"NOT {m} rlike r'(?:^|\\.)0[0-9]'"),
        "card": two(luhn(m)),
        "phone": maybe(f"{n} BETWEEN 10 AND 13"),
        "account": f"if({n} >= 9, 1, -1)",
    }[kind]
    edges = two(f"NOT ({before} rlike r'[\\p{{L}}\\p{{N}}]$' OR {after} rlike r'^[\\p{{L}}\\p{{N}}]')")
    context = maybe(f"lower({before}) rlike {q(WORDS[kind])}")
    votes_ = dict(zip(LABELERS, (strict, gazetteer, context, structure, edges)))
    return ", ".join(f"'{k}', {v}" for k, v in votes_.items())


def candidates(docs: DataFrame, text_col: str, keep: Column) -> DataFrame:
    """(keep, t, spans): the column keep as it is, the text and its candidates: array of (k, kind, start, end, base, votes...)."""
    x = docs.select(keep.alias("keep"), F.coalesce(col(text_col), F.lit("")).alias("t"))
    x = x.withColumns({f"c_{k}": F.expr(found(p, GUARD.get(k))) for k, p in PATTERNS.items()} | {f"l_{k}": F.expr(found(p, GUARD_LOOSE[k], True)) for k, p in LOOSE.items()})

    def judged(kind: str, column: str, loose: bool) -> str:
        base = "false" if loose else base_rule(kind, "c.m")
        head = f"'k', {KINDS.index(kind)}, 'start', c.start, 'end', c.start + length(c.m), 'base', {base}"
        return f"transform({column}, c -> named_struct({head}, {votes(kind, f'if({base}, 1, -1)', 'c.m', 'c.before', 'c.after')}))"

    # short digit runs are no card candidates
    x = x.withColumn("c_card", F.expr(f"filter(c_card, c -> length({digits('c.m')}) BETWEEN 13 AND 19)"))
    parts = [judged(k, f"c_{k}", False) for k in PATTERNS] + [judged(k, f"l_{k}", True) for k in LOOSE]
    return x.select("keep", "t", F.expr(f"concat({', '.join(parts)})").alias("spans"))


# --------------------------------------------------------------------------- the label model and the classifier
#: Inputs of the classifier: a bias for each kind, the votes, and two pairs of votes that agree.
INPUTS = len(KINDS) + len(LABELERS) + 2


def inputs(field: str) -> str:
    """SQL: the classifier's inputs of a struct of k and votes."""
    kinds = [f"if({field}.k = {i}, 1D, 0D)" for i in range(len(KINDS))]
    pairs = [f"if({field}.{a} > 0 AND {field}.{b} > 0, 1D, 0D)" for a, b in (("strict", "edges"), ("gazetteer", "context"))]
    return f"array({', '.join([*kinds, *(f'double({field}.{j})' for j in LABELERS), *pairs])})"


def total(of: str) -> str:
    return f"aggregate({of}, 0D, (s, v) -> s + v)"


def label_model(rounds: int = 12) -> str:
    """SQL: posteriors of one kind's patterns (array pats of n, hit: the indexes of its votes, score), by expectation maximisation.

    A round takes the labelers' reliabilities from the posteriors and the posteriors from them; the first posteriors
    are the majority's.
    """
    cells = len(LABELERS) * len(VOTES)
    counts = lambda w: f"transform(sequence(0, {cells - 1}), c -> {total(f'zip_with(pats, ps, (a, p) -> if(array_contains(a.hit, c), a.n * {w}, 0D))')})"
    odds = f"ln((y + 1) / (n0 - y + 1)) + {total('transform(a.hit, c -> ln((get(ys, c) + 1) / (y + 3)) - ln((get(xs, c) + 1) / (n0 - y + 3)))')}"
    step = f"transform(pats, a -> 1 / (1 + exp(-({odds}))))"
    step = let(counts("p"), "ys", let(counts("(1 - p)"), "xs", step))
    step = let(total("zip_with(pats, ps, (a, p) -> a.n * p)"), "y", let(total("transform(pats, a -> a.n)"), "n0", step))
    return f"aggregate(sequence(1, {rounds}), transform(pats, a -> if(a.score > 0, 0.9D, 0.1D)), (ps, r) -> {step})"


def train_classifier(rounds: int = 20, rate: float = 2.0, decay: float = 1e-3) -> str:
    """SQL: weights of a logistic regression on soft labels (array pats of n, p, x), by gradient steps with momentum."""
    each = f"transform(pats, a -> a.n * (a.p - 1 / (1 + exp(-{total('zip_with(s.w, a.x, (u, v) -> u * v)')}))))"
    slope = f"{total('zip_with(pats, miss, (a, m) -> m * get(a.x, d))')} / n0"
    speed = f"transform(s.speed, (v, d) -> 0.6D * v + {rate}D * ({slope} - {decay}D * get(s.w, d)))"
    move = let(speed, "now", "named_struct('w', zip_with(s.w, now, (u, v) -> u + v), 'speed', now)")
    zero = f"array_repeat(0D, {INPUTS})"
    return let(total("transform(pats, a -> a.n)"), "n0", f"aggregate(sequence(1, {rounds}), named_struct('w', {zero}, 'speed', {zero}), (s, r) -> {let(each, 'miss', move)}, s -> s.w)")


def fit(cands: DataFrame) -> list[float]:
    """Classifier weights from all candidates in column spans. The vote patterns, 3^5 for each kind at most, meet in one row."""
    each = cands.select(F.explode("spans").alias("x")).select("x.k", *[f"x.{j}" for j in LABELERS])
    patterns = staged(each.groupBy("k", *LABELERS).agg(F.count("*").cast("double").alias("n")), "pii-patterns")
    hit = ", ".join(f"{len(VOTES) * i} + {j} + 1" for i, j in enumerate(LABELERS))
    votes_ = ", ".join(f"'{j}', {j}" for j in LABELERS)
    one = F.expr(f"named_struct('hit', array({hit}), 'n', n, 'score', {' + '.join(LABELERS)}, 'x', {inputs(f"named_struct('k', k, {votes_})")})")
    kinds = patterns.groupBy("k").agg(F.sort_array(F.collect_list(one)).alias("pats"))
    soft = kinds.select("k", F.expr(f"zip_with(pats, {label_model()}, (a, p) -> named_struct('n', a.n, 'p', p, 'x', a.x))").alias("pats"))
    row = soft.agg(F.expr("flatten(transform(sort_array(collect_list(struct(k, pats))), g -> g.pats))").alias("pats")).select(F.expr(f"if(size(pats) = 0, array_repeat(0D, {INPUTS}), {train_classifier()})").alias("w")).first()
    return [round(w, 9) for w in row["w"]]


def with_spans(cands: DataFrame, weights: list[float], least: float = 0.5) -> DataFrame:
    """Cands with base and all: sorted arrays of (k, start, end), base spans and all spans.

    Of spans that the classifier adds, those stay that touch neither a base span nor an earlier one of their own.
    """
    cut = log(least / (1 - least))
    narrow = "x -> named_struct('k', x.k, 'start', x.start, 'end', x.end)"
    odds = total(f"zip_with({inputs('x')}, array({', '.join(f'{w!r}D' for w in weights)}), (u, v) -> u * v)")
    x = cands.withColumn("base", F.expr(f"array_sort(transform(filter(spans, x -> x.base), {narrow}))"))
    x = x.withColumn("more", F.expr(f"transform(filter(spans, x -> NOT x.base AND {odds} >= {cut!r}D), {narrow})"))
    # by start, base spans first: the furthest end before each, and (from behind) the next base span's start
    sort = "array_sort(concat(transform(base, x -> named_struct('start', x.start, 'own', 1, 'k', x.k, 'end', x.end)), transform(more, x -> named_struct('start', x.start, 'own', 2, 'k', x.k, 'end', x.end))))"
    ends = before_each("transform(line, x -> x.end)", "-1L", "greatest(s, v)")
    nexts = f"reverse({before_each('reverse(transform(line, x -> if(x.own = 1, x.start, 9223372036854775807L)))', '9223372036854775807L', 'least(s, v)')})"
    free = "transform(filter(line, (x, i) -> x.own = 2 AND get(ends, i) <= x.start AND get(nexts, i) >= x.end), x -> named_struct('k', x.k, 'start', x.start, 'end', x.end))"
    free = let(sort, "line", let(ends, "ends", let(nexts, "nexts", free)))
    return x.withColumn("all", F.expr(f"if(size(more) = 0, base, array_sort(concat(base, {free})))")).drop("more")


def spans_text(column: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.start, x.end)), ',')")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id>, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    Cases: null and empty texts have no spans (the digest is that of the empty string); ids may repeat or be
    null, rows are judged one by one; equal vote patterns are judged alike; without candidates nothing is
    trained and nothing is added; an empty table gives no rows; other columns are ignored.
    """
    cands = staged(candidates(docs, text_col, col(id_col)).drop("t"), "pii-candidates")
    x = with_spans(cands, fit(cands))
    count = {f"n_{k}": F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)") for i, k in enumerate(KINDS[:4])}
    return x.select(F.col("keep").alias(id_col), *[c.alias(n) for n, c in count.items()], F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("all").alias("spans"))


def redacted() -> str:
    """SQL: text t with all its spans replaced by their kinds in brackets; spans that touch become the first one's kind."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    cut = f"substring(array_join(slice(chunks, int(a div {CHUNK}) + 1, int(z div {CHUNK} - a div {CHUNK}) + 1), ''), int(a % {CHUNK}) + 1, int(z - a))"
    text = lambda a, z: let(a, "a", let(z, "z", f"if(z > a, {cut}, '')"))
    piece = f"if(x.start < get(ends, i), '', concat({text('get(ends, i)', 'x.start')}, element_at(array({names}), x.k + 1)))"
    last = text("aggregate(line, 0L, (s, x) -> greatest(s, x.end))", "cast(length(t) as bigint)")
    new = f"concat(array_join(transform(line, (x, i) -> {piece}), ''), {last})"
    new = let(before_each("transform(line, x -> x.end)", "0L", "greatest(s, v)"), "ends", new)
    new = let(f"regexp_extract_all(t, r'(?s).{{1,{CHUNK}}}', 0)", "chunks", new)
    return let("array_sort(transform(all, x -> named_struct('start', x.start, 'end', x.end, 'k', x.k)))", "line", new)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Docs with every span replaced by its kind in brackets; same columns, length_col set anew where a text changed.

    Cases: null texts stay null, texts without spans stay as they are; rows that repeat change alike; an empty table
    stays empty; columns may have any names.
    """
    cands = staged(candidates(docs, text_col, F.struct(*[col(c) for c in docs.columns])), "pii-candidates")
    x = with_spans(cands, fit(cands)).select("keep", F.expr(f"if(size(all) > 0, {redacted()}, null)").alias("new"))
    types = dict(docs.dtypes)

    def value(c: str) -> Column:
        old = F.col("keep").getField(c)
        return F.coalesce(F.col("new"), old) if c == text_col else F.coalesce(F.length("new").cast(types[c]), old) if c == length_col else old

    return x.select(*[value(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
