import pytest
from pyspark.sql import functions as F

from surveyspark import fixed_values as V
from surveyspark.operators import recode as R
from surveyspark.sources import dictionary as D
from tests.conftest import VARIABLES, rows, write_csv


def test_variables(dictionary):
    assert dictionary.names == [v[1] for v in VARIABLES]
    assert dictionary.block("peso", "perfil") == ["peso_amostral", "idade", "sexo", "escola_publica"]
    assert dictionary.types["peso_domicilio_pessoas"] == "double"  # patched
    assert dictionary.common(["092020", "112020"]) == [
        v[1] for v in VARIABLES if v[0] != "A006A"
    ]


def test_categories(dictionary):
    c = dictionary.categories
    assert c["uf"][35] == "São Paulo"  # the last of a repeated code
    assert c["sexo"] == {1: "Homem", 2: "Mulher"}  # '2.0' is a code
    assert c["sintoma_febre"][9] == "Ignorado"
    assert "idade" not in c  # a domain text and a blank are not codes
    assert c["XYZ"] == {1: "fora"}  # an undocumented variable keeps its code as name


def test_rename_keeps_documented_columns_in_dictionary_order(raw, dictionary):
    df = R.rename_by_dictionary(raw, dictionary)
    assert df.columns == [*dictionary.names, V.PERIOD]
    assert "NOTA" not in df.columns


def test_missing_variables(raw, dictionary):
    assert rows(R.missing_variables(raw.drop("A006A", "C007"), dictionary)) == [
        ("A006A", "escola_publica"), ("C007", "trabalho_unico_principal_semana"),
    ]
    assert R.missing_variables(raw, dictionary).count() == 0


def test_recode_is_rename_cast_decode(raw, dictionary, labelled):
    steps = R.decode_categories(
        R.cast_by_dictionary(R.rename_by_dictionary(raw, dictionary), dictionary), dictionary
    )
    assert steps.dtypes == labelled.dtypes
    assert sorted(map(str, rows(steps))) == sorted(map(str, rows(labelled)))


def test_decoded_values(labelled):
    first = labelled.where((F.col(V.PERIOD) == "2020-09") & (F.col("id_morador") == "04")).first()
    assert first["uf"] == "Rondônia"
    assert first["idade"] == 1  # '1.5' in an integer column is cut, and not decoded away
    assert first["sexo"] is None  # code 7 has no label
    assert first["peso_amostral"] == 100.5  # a double is never decoded
    assert first["peso_domicilio_pessoas"] == 150.75
    assert first["mes_entrevista"] == 9  # declared domain: stays a number
    last = labelled.where((F.col(V.PERIOD) == "2020-09") & (F.col("upa") == 200)).first()
    assert last["peso_amostral"] is None  # 'abc'
    assert last["valor_auxilio_emergencial"] == 600  # domain wins over a category entry


def test_long_code_tables_are_joined(spark):
    codes = {k: f"L{k}" for k in range(R.INLINE_CODES + 1)}
    d = D.Dictionary((D.Variable("X", "x", "id", "integer"),), {"x": codes})
    raw = spark.createDataFrame([("7",), ("5000",), (None,), ("bad",)], "X string")
    out = R.recode(raw, d, keep=())
    assert sorted(map(str, rows(out))) == ["('L7',)", "(None,)", "(None,)", "(None,)"]
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString()


def test_dual_labels_and_missing_codes(raw, dictionary):
    typed = R.cast_by_dictionary(R.rename_by_dictionary(raw, dictionary), dictionary)
    dual = R.dual_code_label(typed.select("sexo", "idade"), dictionary)
    assert dual.columns == ["sexo", "sexo_label", "idade"]
    assert set(rows(dual.select("sexo", "sexo_label").distinct())) == {
        (1, "Homem"), (2, "Mulher"), (7, None),
    }
    nulled = R.null_missing_codes(typed.select("sintoma_tosse"), {"sintoma_tosse": [9]})
    assert set(rows(nulled.distinct())) == {(2,), (None,)}


def test_blocks_and_dimensions(labelled, dictionary):
    block = R.project_block(labelled, dictionary, "saude", extra=["sexo", "uf", "nowhere"])
    ids = dictionary.block("id", "peso")
    assert block.columns == [*ids, V.PERIOD, *dictionary.block("saude"), "sexo"]
    profile = R.dim_profile(labelled, dictionary)
    assert profile.columns == [
        *V.PANEL_KEY, "upa", V.PERIOD, *dictionary.block("perfil"), "faixa_etaria"
    ]
    bands = rows(profile.where(F.col(V.PERIOD) == "2020-09").select("id_morador", "upa", "faixa_etaria"),
                 "id_morador", "upa")
    assert bands == [("01", 100, "30-44"), ("01", 200, "75+"), ("02", 100, "00-17"),
                     ("03", 100, "75+"), ("04", 100, "00-17")]  # 03 has no age
    location = R.dim_location(labelled)
    assert set(rows(location.select("uf", "regiao").distinct())) == {
        ("São Paulo", "Sudeste"), ("Rondônia", "Norte"),
    }
    time = rows(R.dim_time(labelled), V.PERIOD)
    assert time == [(9, 1, "2020-09", "Pico da Primeira Onda"), (10, 1, "2020-10", "Desaceleracao"),
                    (11, 1, "2020-11", "Desaceleracao")]


def test_published_dictionary_keeps_nulls(spark, survey_files):
    table = D.read_dictionary_csv(spark, str(survey_files / "variaveis.csv_dict"))
    out = R.dim_dictionary(table)
    assert out.columns == list(V.PUBLISHED_DICTIONARY_COLUMNS)
    got = {r["nome_semantico"]: r for r in out.collect()}
    assert got["peso_domicilio_pessoas"]["tipo"] == "double"
    assert got["uf"]["dominio"] is None
    assert got["uf"]["descricao_variavel"] == 'Pergunta "uf", texto'


@pytest.mark.parametrize("packed", ["1b", "1g"])
def test_the_last_line_of_the_last_file_wins(spark, tmp_path, dictionary, packed):
    """However the files are dealt to tasks, and in whatever order they are named; the larger file is read first."""
    header = ["codigo_variavel", "valor", "descricao_valor"]
    old = [["UF", str(k), f"old {k}\nof {k}"] for k in range(300)]
    write_csv(tmp_path / "a.csv", header, [*old, ["UF", "7", "later"], ["UF", "8", "later"]])
    write_csv(tmp_path / "b.csv", header, [["UF", "8", "first"], ["UF", "8", "last"], ["UF", "x", "none"]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", packed)
    try:
        table = D.read_dictionary_csv(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")])
        codes = D.collect_categories(D.category_codes(table, dictionary))["uf"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(codes) == 300
    assert (codes[6], codes[7], codes[8]) == ("old 6\nof 6", "later", "last")
