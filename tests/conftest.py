"""Session and a synthetic mini-survey."""

import csv
import gzip
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("surveyspark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# ---- mini-survey -----------------------------------------------------------------------------

VARIABLE_HEADER = [
    "codigo_variavel", "nome_semantico", "descricao_variavel", "bloco", "tipo", "dominio",
    "tamanho", "quesito", "parte", "meses",
]
ALL = "092020,102020,112020"
VARIABLES = [
    # code, name, block, type, domain, months
    ("Ano", "ano_referencia", "id", "integer", "", ALL),
    ("UF", "uf", "id", "string", "", ALL),
    ("UPA", "upa", "id", "integer", "número", ALL),
    ("V1008", "id_domicilio", "id", "string", "", ALL),
    ("A001", "id_morador", "id", "string", "01 a 30", ALL),
    ("V1013", "mes_entrevista", "id", "integer", "1 a 12", ALL),
    ("V1016", "num_entrevista", "id", "integer", "", ALL),
    ("V1022", "situacao_domicilio", "id", "integer", "", ALL),
    ("V1031", "peso_domicilio_pessoas", "id", "integer", "peso", ALL),
    ("V1032", "peso_amostral", "peso", "double", "", ALL),
    ("A002", "idade", "perfil", "integer", "", ALL),
    ("A003", "sexo", "perfil", "integer", "", ALL),
    ("A006A", "escola_publica", "perfil", "integer", "", "112020"),
    ("B0011", "sintoma_febre", "saude", "integer", "", ALL),
    ("B0012", "sintoma_tosse", "saude", "integer", "", ALL),
    ("B0014", "sintoma_dificuldade_respirar", "saude", "integer", "", ALL),
    ("B0019", "sintoma_fadiga", "saude", "integer", "", ALL),
    ("B00111", "sintoma_perda_olfato_paladar", "saude", "integer", "", ALL),
    ("B002", "buscou_atendimento_saude", "comportamento", "integer", "", ALL),
    ("C001", "trabalhou_na_semana", "comportamento", "integer", "", ALL),
    ("C002", "estava_afastado_com_vinculo", "comportamento", "integer", "", ALL),
    ("C015", "procurou_trabalho_semana", "comportamento", "integer", "", ALL),
    ("C011A12", "renda_efetiva_trabalho_principal", "economico", "double", "", ALL),
    ("D0053", "valor_auxilio_emergencial", "economico", "integer", "valor em reais", ALL),
    ("C007", "trabalho_unico_principal_semana", "trabalho", "integer", "", ALL),
    ("F001", "domicilio", "habitacao", "integer", "", ALL),
]
YES_NO = [("1", "Sim"), ("2", "Não"), ("3", "Não sabe"), ("9.0", "Ignorado")]
CATEGORIES = [
    ("UF", "11", "Rondônia"), ("UF", "35", "Sao Paulo (antigo)"), ("UF", "35", "São Paulo"),
    ("V1022", "1", "Urbana"), ("V1022", "2", "Rural"),
    ("A002", "000 a 130", "Idade"), ("A002", "", "Não aplicável"),
    ("A003", "1", "Homem"), ("A003", "2.0", "Mulher"),
    ("V1032", "1", "nunca"), ("D0053", "600", "nunca"), ("XYZ", "1", "fora"),
    *[
        (code, value, label)
        for code in ("B0011", "B0012", "B0014", "B0019", "B00111", "B002", "C001", "C002", "C015")
        for value, label in YES_NO
    ],
]


def write_csv(path, header, rows, encoding="utf-8"):
    opener = gzip.open if str(path).endswith(".gz") else open
    with opener(path, "wt", encoding=encoding, newline="") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)


def person(**answers):
    base = {
        "Ano": "2020", "UF": "35", "UPA": "100", "V1008": "01", "A001": "01", "V1013": "9",
        "V1016": "1", "V1022": "1", "V1031": "150.75", "V1032": "100.5", "A002": "40",
        "A003": "1", "A006A": "1", "B0011": "2", "B0012": "2", "B0014": "2", "B0019": "2",
        "B00111": "2", "B002": "2", "C001": "1", "C002": "", "C015": "", "C011A12": "",
        "D0053": "", "C007": "4", "F001": "1", "NOTA": "não documentada",
    }
    return base | answers


PEOPLE = [
    person(A001="01", B0011="1", C011A12="1500.5"),
    person(A001="02", A002="10", A003="2", B0012="9", C001="2", C002="1"),
    person(A001="03", A002="", B0014="1", B0019="1", C001="2", C002="2", C015="1", V1032="50"),
    person(A001="04", A002="1.5", UF="11", A003="7", C001="2", C002="2", C015="2", V1008="02"),
    # same documented key as the first, another sampling unit
    person(A001="01", UPA="200", A002="80", V1032="abc", C001="", D0053="600"),
]


@pytest.fixture(scope="session")
def survey_files(tmp_path_factory):
    """Three months (the last with a column inserted mid-file), a gzip twin, a stray file."""
    root = tmp_path_factory.mktemp("microdata")
    codes = [v[0] for v in VARIABLES]
    for month, mes in (("092020", "9"), ("102020", "10"), ("112020", "11")):
        header = [c for c in codes if c != "A006A" or month == "112020"] + ["NOTA"]
        rows = [[(p | {"V1013": mes})[c] for c in header] for p in PEOPLE]
        write_csv(root / f"survey_{month}.csv", header, rows, "iso-8859-1")
        if month == "102020":
            write_csv(root / f"survey_{month}.csv.gz", header, rows, "iso-8859-1")
    write_csv(root / "leia_me.csv", ["a"], [["b"]])
    write_csv(
        root / "variaveis.csv_dict", VARIABLE_HEADER,
        [
            [c, n, f'Pergunta "{n}", texto', b, t, d, "1", "Q", "Parte A", m]
            for c, n, b, t, d, m in VARIABLES
        ],
    )
    names = {v[0]: v[1] for v in VARIABLES}
    write_csv(
        root / "categorias.csv_dict",
        ["codigo_variavel", "nome_semantico", "valor", "descricao_valor", "parte", "meses"],
        [[c, names.get(c, ""), v, label, "Parte A", ALL] for c, v, label in CATEGORIES],
    )
    return root


@pytest.fixture(scope="session")
def dictionary(spark, survey_files):
    from surveyspark import fixed_values as V
    from surveyspark.sources.dictionary import read_dictionaries

    return read_dictionaries(
        spark, str(survey_files / "variaveis.csv_dict"), str(survey_files / "categorias.csv_dict"),
        V.TYPE_OVERRIDES,
    )


@pytest.fixture(scope="session")
def raw(spark, survey_files):
    from surveyspark.sources import microdata as MD

    kept, _ = MD.dedupe_period_files(MD.discover_periods(spark, f"{survey_files}/*.csv*"))
    return MD.read_periods(spark, kept)


@pytest.fixture(scope="session")
def labelled(raw, dictionary):
    from surveyspark.operators.recode import recode

    return recode(raw, dictionary)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
