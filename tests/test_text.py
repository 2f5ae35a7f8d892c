import pytest
from pyspark.sql import functions as F

from glyphtally.functions import affixes, cleaning, tokens
from glyphtally.functions.lexicon import ABBREVIATIONS, UNITS


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("veja https://a.b/c?x=1 já", "veja já"), ("escreva a joao@mail.com.br hoje", "escreva a hoje"), ("oi @joão tudo", "oi tudo"), ("ip 10.0.0.1 fim.", "ip fim."),
        ("ISBN 978-85-333-0227-3 livro: bom", "livro : bom"), ("isbn 123", "isbn 123"), ("bom :) dia XD fim", "bom dia fim"), ("casa(azul)grande", "casa (azul) grande"),
        ("sim,não", "sim , não"), ("é,não", "é,não"), ("12;A e 13;B", "12 ; A e 13 ; B"), ("Gênesis 18:23-33;Êxodo 1:17", "Gênesis 18:23-33 ; Êxodo 1:17"), ("fim... agora", "fim agora"), ("a  b", "a b"), ("café", "café"), ("日本 ok", "ok"), ("", ""), (None, None),
    ],
)
def test_clean(spark, text, want):
    assert one(spark, cleaning.clean, text) == want


@pytest.mark.parametrize(
    "token, want",
    [("nº", "numero"), ("N.º", "numero"), ("Dr.", "doutor"), ("Prof.ª", "professor"), ("U.S.A", "usa"), ("km²", "quilometro_quadrado"), ("vê-lo", "ver"), ("disse-lhe", "disse"), ("Casa,", "casa"), ("min", "minuto"), ("guarda-chuva", "guarda-chuva"), ("3.5", "3.5"), ("n.", "n")],
)
def test_normalize(spark, token, want):
    assert one(spark, tokens.normalize, token) == want


def test_tables():
    assert len(ABBREVIATIONS) == 40 and len(UNITS) == 55


def test_tokens(spark):
    got = one(spark, tokens.tokenize, "O Dr. Silva, Ph.D., mora a 3,5 km n.º 12 da R$ guarda-chuva (U.S.A.)")
    assert got == ["O", "Dr.", "Silva", ",", "Ph.D.", ",", "mora", "a", "3,5", "km", "n.º", "12", "da", "R", "$", "guarda-chuva", "(", "U.S.A.", ")"]
    assert one(spark, lambda t: tokens.normalized(tokens.tokenize(t), ["o", "a"]), "O preço, a 10 % !") == ["preço", "10", "%"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("O Dr. Silva, Ph.D., mora", "O|Dr|.|Silva|,|Ph.D.|,|mora"), ("a 3,5 km n.º 12", "a|3,5|km|n.º|12"), ("n . º 5 e n. 7, n.8", "n . º|5|e|n.|7|,|n.8"), ("n. de n .", "n|.|de|n|."), ("R$ 50 R$50 US$5 50% 50€", "R$|50|R$|50|US$|5|50|%|50|€"),
        ("guarda-chuva (U.S.A.)", "guarda-chuva|(|U.S.A.|)"), ("10km/h e/ou km/h 12m²", "10|km/h|e|/|ou|km|/|h|12|m²"), ("fim... casa- -casa vê-lo", "fim|...|casa-|-casa|vê-lo"), ("a.B s.a. AB. x.", "a|.|B|s.a|.|AB|.|x|."), ("18:23 3;4 tom:um a,b 1,2", "18:23|3;4|tom|:|um|a|,|b|1,2"),
        ("((a)) [b]!? _c_", "(|(|a|)|)|[|b|]|!|?|_|c|_"), ("5°C. 3º B.Sc. b.sc. M.Sc", "5°C|.|3º|B.Sc.|b.sc.|M.Sc"), ("+55 x+1 3-4 1+2", "+55|x+1|3-4|1|+|2"), ("", ""), ("  ", ""),
    ],
)
def test_affixes(text, want):
    assert "|".join(affixes.tokens(text)) == want


def test_process(spark):
    """Cleaning, tokens, normal forms and stop words, end to end, worked out by hand."""
    d = spark.createDataFrame([(1, 1, "O Prof. Silva (https://a.b/c) viu-os a 10km/h :) , 50% de n.º 3!"), (2, 1, "... !!"), (3, 1, None)], "doc_id long, part int, text string")
    out = {r.doc_id: r.tokens for r in tokens.process(d, "pt", ["o", "a", "de"]).collect()}
    assert out == {1: ["professor", "silva", "viu", "10", "quilometro_hora" if "km/h" in UNITS else "km/h", "50", "%", "numero", "3"], 2: [], 3: out[3]} and not out[3]
    plain = {r.doc_id: r.tokens for r in tokens.process(d, "pt", ["o", "a", "de"], affixes=False).collect()}
    assert plain[1][:3] == ["professor", "silva", "viu"] and plain[2] == []


def test_minimal_and_plurals(spark):
    assert one(spark, tokens.minimal, "O Dr. viu 3,5 km² (sim)!") == ["o", "dr", "viu", "3,5", "km²", "sim"]
    d = spark.createDataFrame([(1, "casa casa casas as a os gas mes mesas".split()), (2, "gatos gato gatos".split())], "doc_id long, tokens array<string>")
    assert sorted(map(tuple, tokens.plural_lemmas(d).collect())) == [("casas", "casa")]


def test_speed(spark, tmp_path):
    d = spark.createDataFrame([(1, 1, ["a", "b"]), (2, 1, [])], "doc_id long, part int, tokens array<string>")
    stats, speed = tokens.timed_stats(spark, lambda: d, f"{tmp_path}/t")
    assert stats.first().tokens == 2 and speed > 0


def test_lemmas_and_stats(spark):
    d = spark.createDataFrame([(1, 1, ["casas", "metro", "de"]), (2, 1, []), (3, 2, ["x"])], "doc_id long, part int, tokens array<string>")
    lemmas = spark.createDataFrame([("casas", "casa"), ("metro", "nada"), ("x", "de")], "form string, lemma string")
    out = tokens.lemmatize(d, lemmas, ["de"])
    assert {r.doc_id: r.tokens for r in out.collect()} == {1: ["casa", "metro"], 2: [], 3: []}
    assert {r.part: (r.docs_in, r.docs_out, r.docs_empty, r.tokens, r.lost_percent) for r in tokens.run_stats(d).collect()} == {1: (2, 1, 1, 3, 50.0), 2: (1, 1, 0, 1, 0.0)}


def test_token_lists_by_slices():
    import pyarrow as pa

    from glyphtally.functions import affixes

    texts = [None if i % 7 == 0 else f"Dr. {i} n. {i} km²" for i in range(2 * affixes.TEXTS + 3)]
    assert affixes.token_lists(pa.array(texts)).to_pylist() == [None if t is None else affixes.tokens(t) for t in texts]
    assert affixes.token_lists(pa.array([], pa.string())).to_pylist() == []
