"""Multi-field queries: disjunction maximum with boosts, minimum-should-match, tie-breaking and phrase boosts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postlane.functions.query_syntax import field_boosts, minimum_should_match
from postlane.functions.similarity import Similarity, default_bm25
from postlane.functions.tokenizers import Tokenizer
from postlane.operators import phrases
from postlane.operators.index import SearchIndex


def parse_query(tokenizers: Mapping[str, Tokenizer], q: str, names: Sequence[str]) -> tuple[dict[str, list[str]], bool]:
    """({field: terms}, whether all fields cut the query into as many terms, so that it can be scored term by term)."""
    terms = {}
    for name in names:
        if name not in tokenizers:
            raise ValueError(f"no such field: {name}")
        terms[name] = tokenizers[name](q)
    sizes = {len(t) for t in terms.values()}
    return terms, len(sizes) == 1


@dataclass(frozen=True)
class Reading:
    """How a query is read: what that takes is the fields' tokenizers, no document."""

    boosts: dict[str, float | None]
    terms: dict[str, list[str]]
    term_centric: bool
    #: By field how many of its terms must match; by term they are those of any field.
    need: dict[str, int]
    #: By field its phrases and their boosts.
    phrases: dict[str, list[tuple[list[str], float]]]
    explain: str


def read_query(
    tokenizers: Mapping[str, Tokenizer],
    q: str,
    qf: str | Sequence[str],
    mm: str | int | None = None,
    pf: str | Sequence[str] | None = None,
    pf2: str | Sequence[str] | None = None,
    pf3: str | Sequence[str] | None = None,
    q_op: str = "OR",
) -> Reading:
    """The query of edismax(), by the fields' tokenizers alone."""
    boosts = field_boosts(qf)
    spec = "100%" if q_op == "AND" else mm
    phrase_boosts = [field_boosts(x) for x in (pf, pf2, pf3)]
    for name in {x for b in phrase_boosts for x in b} - set(boosts):
        raise ValueError(f"phrase field {name} is not in qf")
    terms, term_centric = parse_query(tokenizers, q, list(boosts))
    if term_centric:
        n = len(next(iter(terms.values())))
        least = minimum_should_match(n, spec)
        need = dict.fromkeys(boosts, least)
        explain = "(" + " ".join("(" + " | ".join(f"{f}:{terms[f][k]}^{_mark(b)}" for f, b in boosts.items()) + ")" for k in range(n)) + f")~{least}"
    else:
        need = {f: min(minimum_should_match(len(terms[f]), spec), len(terms[f])) for f in boosts}
        explain = " | ".join("((" + " ".join(f"{f}:{t}" for t in terms[f]) + f")~{need[f]})^{_mark(b)}" for f, b in boosts.items())
    added: dict[str, list[tuple[list[str], float]]] = {}
    for size, wanted in zip((None, 2, 3), phrase_boosts if any(terms.values()) else ()):
        for f, b in wanted.items():
            n = len(terms[f]) if size is None else size
            if n < 2 or len(terms[f]) < n:
                continue
            grams = _ngrams(terms[f], n)
            explain += "".join(f' ({f}:"{" ".join(g)}")^{_mark(b)}' for g in grams)
            if size == 2:
                grams = [*grams, grams[-1]]  # the last pair of a field counts twice
            added.setdefault(f, []).extend((g, 1.0 if b is None else b) for g in grams)
    return Reading(boosts, terms, term_centric, need, added, explain)


def _term_scores(index: SearchIndex, field: str, terms: list[str], boost: float, similarity: Similarity) -> DataFrame:
    """(doc_id, field, ord, score): one scan of the postings for all terms; a term that occurs twice in the query scores twice."""
    distinct = list(dict.fromkeys(terms))
    pick = lambda cases: reduce(lambda w, tv: w.when(F.col("term") == tv[0], tv[1]), cases[1:], F.when(F.col("term") == cases[0][0], cases[0][1]))
    hits = index.postings.where(F.col("term").isin(distinct)).select("term", "doc_id", "tf", "doc_len")
    rows, dfs, avg, n = index.with_numbers(hits, distinct)
    score = similarity(F.col("tf"), [pick(list(zip(distinct, dfs)))], F.col("doc_len"), avg, n).cast("double") * F.lit(float(boost))
    ords = pick([(t, F.array(*(F.lit(k) for k, u in enumerate(terms) if u == t))) for t in distinct])
    return rows.select("doc_id", F.lit(field).alias("field"), F.explode(ords).alias("ord"), score.alias("score"))


def _phrase_scores(index: SearchIndex, grams: list[tuple[list[str], float]], similarity: Similarity, matched: DataFrame) -> DataFrame:
    """(doc_id, score): the boosted sum over the phrases of a field, in one scan, counted among the matched documents alone."""
    distinct = list(dict.fromkeys(t for g, _ in grams for t in g))
    at = {t: k for k, t in enumerate(distinct)}
    rows = index.postings.where(F.col("term").isin(distinct)).join(matched, "doc_id", "left_semi")
    places = rows.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "posns"))).alias("m"), F.max("doc_len").alias("doc_len"))
    wide = places.select("doc_id", "doc_len", *(F.try_element_at("m", F.lit(t)).alias(f"p{k}") for t, k in at.items()))
    dfs = wide.agg(*(F.count(f"p{k}").alias(f"df{k}") for k in at.values()))  # reads what is shuffled for the documents again
    rows = wide.crossJoin(F.broadcast(index.stats)).crossJoin(F.broadcast(dfs))  # a row each

    def one(gram: list[str], boost: float) -> Column:
        tf = phrases.exact([F.col(f"p{at[t]}") for t in gram], gram[0] == gram[1])
        return similarity(tf, [F.col(f"df{at[t]}") for t in gram], F.col("doc_len"), F.col("avg_doc_len"), F.col("n_docs")).cast("double") * F.lit(float(boost))

    return rows.select("doc_id", reduce(lambda a, b: a + b, [one(*g) for g in grams]).alias("score"))


def _ngrams(terms: list[str], n: int) -> list[list[str]]:
    return [terms[k : k + n] for k in range(len(terms) - n + 1)]


def _mark(boost: float | None) -> str:
    return "1" if boost is None else f"{boost}"


def edismax(
    fields: Mapping[str, SearchIndex],
    q: str,
    qf: str | Sequence[str],
    mm: str | int | None = None,
    pf: str | Sequence[str] | None = None,
    pf2: str | Sequence[str] | None = None,
    pf3: str | Sequence[str] | None = None,
    ps: int = 0,
    ps2: int = 0,
    ps3: int = 0,
    tie: float = 0.0,
    q_op: str = "OR",
    similarity: Similarity | Mapping[str, Similarity] = default_bm25,
) -> tuple[DataFrame, str]:
    """((doc_id, score) of every document, how the query was read).

    fields share their doc_ids. qf, pf, pf2 and pf3 name fields, as "title^2" with a boost; pf scores the whole query
    as a phrase, pf2 and pf3 its pairs and triples, all added to documents that qf matches, with document frequencies
    among those. mm says how many terms must match; q_op="AND" means all. ps, ps2 and ps3 are accepted and, as in the
    queries this stands in for, change nothing.
    """
    read = read_query({name: index.tokenizer for name, index in fields.items()}, q, qf, mm, pf, pf2, pf3, q_op)
    boosts, terms, term_centric, need, explain = read.boosts, read.terms, read.term_centric, read.need, read.explain
    sims = {f: (similarity.get(f, default_bm25) if isinstance(similarity, Mapping) else similarity) for f in boosts}
    every = fields[next(iter(boosts))].docs.select("doc_id")

    scored = [_term_scores(fields[f], f, terms[f], 1.0 if b is None or not term_centric else b, sims[f]) for f, b in boosts.items() if terms[f]]
    if not scored:
        return every.select("doc_id", F.lit(0.0).alias("score")), explain

    long = reduce(DataFrame.unionByName, scored)
    top = F.greatest(F.max("score"), F.lit(0.0))
    best = (top + (F.sum("score") - top) * F.lit(float(tie))).alias("d")
    if term_centric:
        per_term = long.groupBy("doc_id", "ord").agg(best)
        per_doc = per_term.groupBy("doc_id").agg(F.sum("d").alias("q"), F.count(F.when(F.col("d") > 0, 1)).alias("n")).where(F.col("n") >= next(iter(need.values())))
    else:
        per_field = long.groupBy("doc_id", "field").agg(F.sum("score").alias("s"), F.count(F.when(F.col("score") > 0, 1)).alias("n"))
        needed = F.create_map(*(x for f in boosts for x in (F.lit(f), F.lit(need[f]))))
        boost = F.create_map(*(x for f, b in boosts.items() for x in (F.lit(f), F.lit(1.0 if b is None else b))))
        per_field = per_field.where(F.col("n") >= needed[F.col("field")]).select("doc_id", (F.col("s") * boost[F.col("field")]).alias("score"))
        per_doc = per_field.groupBy("doc_id").agg(best).withColumnRenamed("d", "q")
    matched = per_doc.where("q > 0").select("doc_id", "q")

    out = matched
    if read.phrases:
        scores = [_phrase_scores(fields[f], grams, sims[f], matched.select("doc_id")) for f, grams in read.phrases.items()]
        extra = reduce(DataFrame.unionByName, scores).groupBy("doc_id").agg(F.sum("score").alias("p"))
        out = out.join(extra, "doc_id", "left").select("doc_id", (F.col("q") + F.coalesce("p", F.lit(0.0))).alias("q"))
    return every.join(out, "doc_id", "left").select("doc_id", F.coalesce("q", F.lit(0.0)).alias("score")), explain
