"""Word tables of the normalizer, by what words become, and stop words. All can be replaced by tables of one's own."""

from __future__ import annotations

#: Expansion: abbreviations.
_ABBREVIATED = """
administração adm|arquiteto arq|artigo art|avenida av|capítulo cap|celular cel|companhia cia|conselheiro cons|departamento dep|doutor dr|doutora dra|edição ed|engenheiro eng
etcétera etc|etcéteras etcs|exemplo ex|fax fax|governo gov|júnior jr|limitada ltda|médico med|observação obs|página pag pg pág|prefeitura pref|professor prof profº|professora profa profª
rodovia rod|rua r|secretaria sec|senhor sr|senhora sra srª|senhorita srta|sociedade_anônima s.a|telefone tel|volume vol
"""
#: Expansion: units.
_UNITS = """
ano_luz al|centilitro cl|centimetro cm|centimetro_cubico cm3 cm³|centimetro_quadrado cm2 cm²|decilitro dl|galao gal|gigabyte gb|grama g|hectare ha|hectopascal hpa|hora h|jarda yd|libra lb|litro l
megabyte mb|metro m|metro_cubico m3 m³|metro_quadrado m2 m²|micrometro μm|milha mi|milha_hora mph|mililitro ml|miligrama mg|milimetro mm|milimetro_cubico mm3 mm³|milimetro_quadrado mm2 mm²
milissegundo ms|minuto min|nanometro nm|onca oz|parsec pc|pascal pa|pe ft|polegada in|quarto qt|quilobyte kb|quilograma kg|quilometro km|quilometro_cubico km3 km³|quilometro_hora kmh
quilometro_quadrado km2 km²|quilopascal kpa|segundo_quadrado s²|segundos s|terabyte tb|unidade_astronomica ua
"""


def _table(text: str) -> dict[str, str]:
    rows = [r.split() for line in text.split("\n") for r in line.split("|")]
    return {form: row[0] for row in rows for form in row[1:]}


ABBREVIATIONS = _table(_ABBREVIATED)
UNITS = _table(_UNITS)
UNITS["min"] = "minuto"
#: Verbs that a clitic has cut.
VERBS = {"revertê": "reverter", "vê": "ver", "fê": "fazer"}
#: Words that no lemma replaces, beside the expansions of units.
PROTECTED = frozenset(f"{stem}{s}" for stem in ("cubico", "cúbico", "quadrado") for s in ("", "s"))
#: Symbols that count as words.
SYMBOLS = "%$£¥€ª°º"
CLITICS = ("me te se lhe lhes nos vos no na nas o os a as lo los la las " + "ei ia ias iam iamos íeis emos eis ás á à ão").split()
#: Short lists for tests and queries; Spark's StopWordsRemover has longer ones, see stop_words().
STOP_WORDS = {
    "pt": "a ao aos as com como da das de do dos e em entre era essa esse esta este eu foi há isso já lhe mais mas me mesmo meu minha muito na nas nem no nos não o os ou para pela pelo por qual quando que quem se sem ser seu sua são só também te tem um uma você à às é".split(),
    "en": "a an and are as at be but by for from had has have he her his i in is it its no not of on or she so that the their they this to was we were which will with you".split(),
}


def stop_words(spark, language: str = "portuguese") -> list[str]:
    """The list of that language that Spark ships."""
    return list(spark.sparkContext._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords(language))
