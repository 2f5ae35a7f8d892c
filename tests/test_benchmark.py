import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphtally.config import Config
from glyphtally.operators import accuracy, ngrams, ppmi, reports, sketches
from glyphtally.plans import benchmark, queries

NAMES = ["CMS-CU", "CML8S-CU", "CML8HS-CU"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, i % 3 + 1, f"a b c{i % 7} d a e{i % 11} f{i} b".split()) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, part int, tokens array<string>")


def stamps(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*") if p.is_file()}


def test_run_resume_show(spark, docs, tmp_path):
    at = str(tmp_path / "run")
    with pytest.raises(FileNotFoundError):
        benchmark.run(spark, docs, at, mode="show")
    with pytest.raises(ValueError):
        benchmark.run(spark, docs, at, mode="ask")
    ks = (2, 5)
    done = benchmark.run(spark, docs, at, Config(parts=3), 3000, "anew", NAMES, ks=ks)
    counts = ngrams.count(ngrams.keys(docs))
    est = sketches.estimate(counts, sketches.build_docs(docs, {n: sketches.params_for(n, 3000) for n in NAMES}))
    want = {r.structure: r for r in accuracy.mre_total(accuracy.mre(est)).collect()}
    got = {r.structure: r for r in done.report.collect()}
    assert set(got) == set(NAMES)
    for n, r in got.items():
        assert r.mre_totais.mre_total == pytest.approx(want[n].mre_total) and r.configuracao.janela == 3
        assert r.estatisticas_insercao_totais.quantidade == 3 and r.estatisticas_consulta_totais.quantidade == counts.count() and r.estatisticas_consulta_totais.media > 0
    ranked = {(r.part, r.structure, r.k): r.recall for r in ppmi.compare(ppmi.exact(counts), ppmi.estimated(counts, est), ks).collect()}
    assert {(r.part, r.structure, r.k): pytest.approx(r.recall) for r in done.rankings.collect()} == ranked
    assert {r.structure for r in done.over_under.collect()} <= {"CML8S-CU", "CML8HS-CU"} and done.missing.count() == 0
    assert (tmp_path / "run/ranking_ppmi_by_part.csv").exists() and (tmp_path / "run/ranking_ppmi_mean.csv").exists()
    # a second run takes counts and sketches as they are, and does the rest again
    before = {k: stamps(f"{at}/{k}") for k in ("counts", "sketches", "report")}
    again = benchmark.run(spark, docs.limit(0), at, Config(parts=3), 3000, "resume", NAMES, ks=ks)
    after = {k: stamps(f"{at}/{k}") for k in before}
    assert before["counts"] == after["counts"] and before["sketches"] == after["sketches"] and before["report"] != after["report"]
    assert {r.structure: r.mre_totais for r in again.report.collect()} == {n: r.mre_totais for n, r in got.items()}
    before = stamps(at)
    shown = benchmark.run(spark, docs, at, mode="show")
    assert {r.structure for r in shown.report.collect()} == set(NAMES) and stamps(at) == before
    text = reports.lines(shown.report)
    assert len(text) == 3 + 3 * len(NAMES) and any(line.startswith("CMS-CU ") for line in text)
    # a sketch that is missing is skipped, a part that has none is named, a write that was cut off is done again
    for n in NAMES:
        shutil.rmtree(f"{at}/sketches/structure={n}/part=2")
    some = benchmark.run(spark, docs, at, Config(parts=3), 3000, "resume", NAMES, ks=ks)
    assert [r.part for r in some.missing.collect()] == [2] and {r.part for r in some.mre.collect()} == {1, 3}
    Path(f"{at}/sketches/_SUCCESS").unlink()
    assert benchmark.run(spark, docs, at, Config(parts=3), 3000, "resume", NAMES, ks=ks).missing.count() == 0


def test_corpus_report(spark, docs, tmp_path):
    from glyphtally.sources import corpus

    counts = ngrams.count(ngrams.keys(docs))
    corpus.write_report(reports.corpus_report(docs, counts), f"{tmp_path}/r")
    (one,) = [json.loads(x) for p in Path(f"{tmp_path}/r").glob("*.json") for x in p.read_text().splitlines()]
    whole, parts = ngrams.stats_global(docs, counts).first(), {r.part: r for r in ngrams.stats_by_part(docs, counts).collect()}
    assert one["configuracao"] == {"janela_bigramas": 3} and one["resumo_geral"]["total_tokens"] == whole.words + whole.pairs and one["resumo_geral"]["total_distintos"] == whole.distinct_words + whole.distinct_pairs
    assert one["estatisticas_documentos"]["media_tokens_por_doc"] == whole.tokens_mean and one["estatisticas_partes"]["media_palavras_por_parte"] == pytest.approx(whole.part_words_mean)
    assert [p["parte"] for p in one["por_parte"]] == [1, 2, 3] and all(p["total_palavras"] == parts[p["parte"]].words and p["pares_distintos"] == parts[p["parte"]].distinct_pairs for p in one["por_parte"])
    assert corpus.read_report(spark, f"{tmp_path}/r").first().resumo_geral.total_partes == 3


def test_log_errors_of_both_sides(spark, sf):
    """Errors over and under the truth by plain loops over the estimates."""
    est = sketches.estimate(queries.counted(spark, sf), queries.six(spark, sf, ["CML8S-CU"])).select("part", "structure", "freq", "est").collect()
    cells = {}
    for r in est:
        if r.est != r.freq:
            cells.setdefault((r.freq, r.part), {True: [], False: []})[r.est > r.freq].append(abs(r.est - r.freq) / r.freq)
    mean = lambda x: sum(x) / len(x) if x else None
    want = {}
    for freq in {f for f, _ in cells}:
        sides = [[mean(c[high]) for (f, _), c in cells.items() if f == freq] for high in (True, False)]
        want[freq] = tuple(mean([x for x in side if x is not None]) or 0.0 for side in sides)
    got = {r.freq: (r.over, r.under) for r in queries.QUERIES["log_over_under"](spark, sf).where(F.col("structure") == "CML8S-CU").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want) and any(o and u for o, u in got.values())


def test_environment_reaches_queries(monkeypatch):
    import subprocess
    import sys

    ask = "from glyphtally.plans import queries, sql; print(queries.CONFIG.window, queries.CONFIG.parts, 'w3' in sql.PAIRS, '% 7 + 1' in sql.TOKENS)"
    monkeypatch.setenv("JANELA", "4")
    monkeypatch.setenv("PARTES", "7")
    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", ask], cwd=root, capture_output=True, text=True, check=True).stdout.split() == ["4", "7", "True", "True"]
