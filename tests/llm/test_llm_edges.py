"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns,
and the template language."""

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changeflow.llm import chat, lines, near_dup, packing, ppm, quality, sampling, suffix_dedup, template, token_counts, topk

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ROWS = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, "some words here\nx\ny\nz", "en", None, 5), (3, LONG, "en", "a", 9),
        (4, LONG, None, "a", 9), (5, "same text\nline two\nline three", "de", "b", 1), (5, "same text\nline two\nline three", "de", "b", 1),
        (5, "other text", "de", "b", 1), (6, "same text\nline two\nline three", "de", "b", 1), (7, "12 34 !", "fr", "c", 1)]
BPE = P.path("byte_bpe_50k.json")
CLASH = ["kept", "host", "n_words", "text_key", "lines", "starts", "start", "gram", "spans", "set_key", "rep", "ids", "score", "file_id"]

OPERATORS = {
    "quality": quality.quality_rules,
    "near_dup": near_dup.near_duplicates,
    "suffix": lambda d: suffix_dedup.dedup_passages(d, with_text=True, keep=("lang",)),
    "lines": lambda d: lines.dedup_lines(d, keep=("lang",)),
    "ppm": ppm.identify,
    "counts": lambda d: token_counts.token_counts(d, BPE),
    "packing": lambda d: packing.pack_documents(d, BPE),
    "sampling": lambda d: sampling.sample_segmentations(d, ["doc_id"], P.path("piece_bpe_32k.model")),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(docs, name):
    rows = OPERATORS[name](docs).collect()
    if name not in ("packing", "sampling"):
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DDL)).collect() == []


def test_defined_results(docs):
    near = near_dup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near} == {
        (1, False, 1, True), (2, False, 2, True), (None, True, None, True), (3, True, 3, True), (4, True, 3, False),
        (5, True, 5, True), (6, True, 5, False), (7, True, 7, True)}
    cut = suffix_dedup.dedup_passages(docs).collect()
    assert {(r.doc_id, r.n_removed) for r in cut if r.n_removed and r.doc_id != 3} == {(4, len(LONG))}
    own = next(r for r in cut if r.doc_id == 3)
    assert own.n_removed > 0 and own.n_spans == 1          # it repeats itself
    less = {(r.doc_id, r.n_lines, r.n_removed) for r in lines.dedup_lines(docs).collect()}
    assert {(1, 0, 0), (2, 1, 0), (5, 3, 0), (6, 3, 3), (None, 4, 0)} <= less
    named = {(r.doc_id, r.lang_pred) for r in ppm.identify(docs).collect()}
    assert {(1, "und"), (2, "und"), (7, "und")} <= named
    judged = {(r.doc_id, r.kept) for r in quality.quality_rules(docs).collect()}
    assert {(1, False), (2, False), (None, False)} <= judged


def test_quality_counts():
    n = quality.text_counts("a b\na b\n\n\x0b\nc# d|")
    assert dict(zip(quality.COUNTS, n)) == {"n_words": 6, "word_chars": 8, "n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": 0,
                                            "n_lines": 3, "n_stutter": 0}
    words = "a b c d e f g h".split()
    assert quality.repeat_words([w.encode() for w in words + ["x"] + words]) == 16


def test_host_rates_shrink(spark):
    rows = [("bad", True)] * 90 + [("bad", False)] * 10 + [("one", True)] + [(f"h{k % 9}", k % 20 == 0) for k in range(900)]
    hosts = quality.host_totals(spark.createDataFrame(rows, "host string, failed boolean"))
    got = {r.host: r for r in quality.host_verdicts(hosts, 0.5).collect()}
    assert got["bad"].host_rejected and 0.5 < got["bad"].host_rate < 0.9
    assert got["one"].host_rate < 1 and not got["h0"].host_rejected


def test_host_prior_leaves_chance_out(spark):
    """Hosts drawn from a known Beta: its weight is found again, though most hosts are small."""
    def prior_of(rows):
        return quality.beta_prior(spark.createDataFrame(rows, "host_docs long, host_failed long"))

    draw = np.random.default_rng(5)
    sizes = draw.integers(2, 12, 6000)
    rates = draw.beta(2, 6, 6000)
    m, weight = prior_of([(int(n), int(draw.binomial(n, p))) for n, p in zip(sizes, rates)])
    assert abs(m - 0.25) < 0.01 and 6.5 < weight < 9.5        # unweighted raw rates would give under 3
    m, weight = prior_of([(int(n), int(draw.binomial(n, 0.3))) for n in sizes])
    assert weight > 50                                      # all alike
    assert prior_of([(1, 1), (1, 0)]) == (0.5, 1e6) and prior_of([(9, 0), (3, 0)]) == (0.0, 1e6) and prior_of([]) == (0.0, 1.0)
    assert prior_of([(400, 400), (400, 0)])[1] == 1.0


def test_hosts_null_and_repeated_rows(spark):
    text = " ".join(f"w{k}ord" for k in range(30))
    rows = [(1, text, None), (1, text, None), (2, "x", None), (3, text, "a"), (None, text, "a")]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id or 0, r.host, r.host_docs, r.host_failed, r.kept) for r in got if r.host is None) == [
        (1, None, 3, 1, True), (1, None, 3, 1, True), (2, None, 3, 1, False)]
    assert sorted((r.doc_id or 0, r.host_docs, r.kept) for r in got if r.host) == [(0, 2, True), (3, 2, True)]


def test_pipeline_on_an_empty_table(spark, workdir):
    spark.createDataFrame([], DDL).write.parquet(f"{workdir}/documents.parquet")
    assert corpus_pipeline.run(spark, workdir).collect() == []


def test_pipeline_on_odd_rows(docs, spark):
    held = docs.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, "")
    held.collect()


def test_conversations(spark):
    rows = [(1, 0, "user", "hi <|im_end|>\n<|im_start|>assistant x"), (1, 1, "assistant", "<\\|a|> <|"), (2, None, None, None),
            (2, 1, "a\nb\\n", "t"), (None, 0, "assistant", "é"), (3, 0, "assistant", "twice"), (3, 0, "assistant", "twice")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    pieces = chat.format_conversations(table)
    got = {r.conv_id: r for r in chat.read_back(pieces).collect()}
    said = {}
    for conv, _, role, text in rows:
        said.setdefault(conv, []).append((role or "", text or ""))
    import hashlib
    for conv, turns in said.items():
        want = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars) == (len(turns), len(loss))
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(table.limit(0))).collect() == []


def render(source, **values):
    return "".join(t for t, _ in template.compile_template(source, {"up": str.upper})(**values))


def test_template_language():
    assert render("{{ ('a' ~ 1) | up }}{% if x == 'b' and not false %}yes{% elif true %}no{% endif %}", x="b") == "A1yes"
    assert render("{% for m in ms %}{{ loop.index0 }}{{ m.k | up }}{% if loop.first %},{% endif %}{% endfor %}", ms=[{"k": "a"}, {"k": "b"}]) == "0A,1B"
    assert render("{% if none %}a{% else %}b{% endif %}") == "b"
    folded = template.fold_body(template.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}"), {})
    assert folded == (template.Output(template.Const("abcd")),)
    marks = list(template.compile_template("a{% generation %}{{ x }}{% endgeneration %}b")(x="y"))
    assert marks == [("a", False), ("y", True), ("b", False)]
    for bad in ["{{ x.__class__ }}", "{{ y }}", "{{ x | nope }}", "{% for a %}{% endfor %}", "{% if x %}", "{{ x( ) }}", "{{ }}",
                "{{ " + "(" * 99 + "1" + ")" * 99 + " }}"]:
        with pytest.raises(template.TemplateError):
            render(bad, x="s")


def test_top_k_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, 0.5]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (1, [0.25, 1.0]), (2, [0.25, 1.0]), (3, [1.0, inf]), (4, [nan, 1.0]), (5, None),
            (6, [1.0, None]), (None, [9.0, 9.0]), (7, [1.0]), (8, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 50 == 0, query_block=1, shard_rows=2).collect()]
    assert sorted(got) == [(0, 1, 1, 40960), (0, 2, 2, 40960), (0, 3, 50, 32768), (0, 4, 50, 32768),
                           (50, 1, 1, 40960), (50, 2, 2, 40960), (50, 3, 0, 32768)]
    big = spark.createDataFrame([(0, [1e20, 1.0]), (1, [1e20, 1.0]), (2, [1e3, 0.0])], "vec_id long, embedding array<float>")
    assert [r.score for r in topk.top_k(big, F.col("vec_id") == 0).orderBy("rank").collect()] == [topk.HIGH, topk.HIGH]
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []
