"""Fixed values of the survey: column names, answer labels, hierarchies and cut points.

Everything here is vocabulary that results must carry verbatim.  No logic.
"""

# --- fixed values: keys, weight, partition -------------------------------------------
PERIOD = "MES_REF"
WEIGHT = "peso_amostral"
PANEL_KEY = ("uf", "id_domicilio", "id_morador", "mes_entrevista")
PANEL_KEY_WITH_PERIOD = ("uf", "id_domicilio", "id_morador", "mes_entrevista", "MES_REF")
# The panel key alone repeats across primary sampling units; this one does not.
FULL_KEY = ("uf", "upa", "id_domicilio", "id_morador", "mes_entrevista", "MES_REF")
TOTAL = "TOTAL"

# --- fixed values: answers -----------------------------------------------------------
YES = "Sim"
NO = "Não"
POSITIVE = "Positivo"
NOT_APPLICABLE = "Nao se aplica"

# --- fixed values: months ------------------------------------------------------------
MONTH_LABELS = {"2020-09": "Set/2020", "2020-10": "Out/2020", "2020-11": "Nov/2020"}

# --- fixed values: age bands, phases, regions ----------------------------------------
AGE_CUTS = (18, 30, 45, 60, 75)
AGE_BANDS = ("00-17", "18-29", "30-44", "45-59", "60-74", "75+")
PHASES = {
    "Inicio da Pandemia": (5, 6),
    "Pico da Primeira Onda": (7, 8, 9),
}
PHASE_OTHERWISE = "Desaceleracao"
REGIONS = {
    "Norte": ("Rondônia", "Acre", "Amazonas", "Roraima", "Pará", "Amapá", "Tocantins"),
    "Nordeste": (
        "Maranhão", "Piauí", "Ceará", "Rio Grande do Norte", "Paraíba", "Pernambuco",
        "Alagoas", "Sergipe", "Bahia",
    ),
    "Sudeste": ("Minas Gerais", "Espírito Santo", "Rio de Janeiro", "São Paulo"),
    "Sul": ("Paraná", "Santa Catarina", "Rio Grande do Sul"),
    "Centro-Oeste": ("Mato Grosso do Sul", "Mato Grosso", "Goiás", "Distrito Federal"),
}

# --- fixed values: indicator columns and their report labels ---------------------------
SYMPTOMS = {
    "sintoma_febre": "Febre",
    "sintoma_tosse": "Tosse",
    "sintoma_dificuldade_respirar": "Dificuldade de respirar",
    "sintoma_perda_olfato_paladar": "Perda de olfato/paladar",
    "sintoma_fadiga": "Fadiga",
}
SPEC_SYMPTOMS = {
    "sintoma_febre": "Febre",
    "sintoma_tosse": "Tosse",
    "sintoma_dificuldade_respirar": "Dific. Respirar",
    "sintoma_perda_olfato_paladar": "Perda Olfato/Paladar",
    "sintoma_fadiga": "Fadiga",
}
COMORBIDITIES = {
    "medico_deu_diagnostico_diabetes": "Diabetes",
    "medico_deu_diagnostico_hipertensao": "Hipertensão",
    "medico_deu_diagnostico_doencas_coracao_infarto_angina": "Doença cardíaca",
}
SPEC_COMORBIDITIES = {
    "medico_deu_diagnostico_diabetes": "Diabetes",
    "medico_deu_diagnostico_hipertensao": "Hipertensão",
    "medico_deu_diagnostico_doencas_coracao_infarto_angina": "Doenças Cardíacas",
}
CARE_PLACES = {
    "local_buscou_atendimento_posto_saude_unidade_basica_saude": "Posto de saúde / UBS",
    "local_buscou_atendimento_pronto_socorro_sus_upa": "Pronto-socorro SUS / UPA",
    "local_buscou_atendimento_hospital_sus": "Hospital SUS",
    "local_buscou_atendimento_ambulatorio_consultorio_privado": "Ambulatório/consultório privado",
    "local_buscou_atendimento_pronto_socorro_privado_ligado": "Pronto-socorro privado",
    "local_buscou_atendimento_hospital_privado_ligado_forcas": "Hospital privado",
}
BENEFITS = {
    "recebeu_auxilio_emergencial": "Auxílio Emergencial",
    "recebeu_aposentadoria_pensao": "Aposentadoria / Pensão",
    "recebeu_bolsa_familia": "Bolsa Família",
    "recebeu_seguro_desemprego": "Seguro Desemprego",
}
TEST_TAKEN = "fez_teste_covid"
TEST_RESULT = "resultado_teste_positivo"
TEST_LABELS = (
    "Realizou teste de COVID",
    "Positivos na população geral",
    "Positivos entre os testados",
)
POPULATION_GROUP = "População geral"
POSITIVE_GROUP = "Testados positivos"
SYMPTOMATIC_GROUP = "Sintomáticos (síndrome gripal)"

# --- fixed values: contact restriction -------------------------------------------------
ISOLATION = "restricao_contato_pessoas_pandemia"
ISOLATION_LEVELS = {
    "Não fez restrição, levou vida normal como antes da pandemia": "Sem restrição",
    "Reduziu o contato com as pessoas, mas continuou saindo de casa para trabalho ou "
    "atividades não essenciais e/ou recebendo visitas": "Reduziu contato",
    "Ficou em casa e só saiu em caso de necessidade básica": "Só saiu p/ necessidades",
    "Ficou rigorosamente em casa": "Rigorosamente em casa",
}
STRICT_ISOLATION = "Ficou rigorosamente em casa"

# --- fixed values: labour market -------------------------------------------------------
LABOUR_STATUS = "situacao_mercado_trabalho"
WORKED, AWAY, LOOKED = (
    "trabalhou_na_semana", "estava_afastado_com_vinculo", "procurou_trabalho_semana",
)
STATUS_WORKED = "Ocupado - trabalhou"
STATUS_AWAY = "Ocupado - afastado"
STATUS_UNEMPLOYED = "Desocupado"
STATUS_OUT = "Fora da forca de trabalho"
LABOUR_STATUSES = (STATUS_WORKED, STATUS_AWAY, STATUS_UNEMPLOYED, STATUS_OUT, NOT_APPLICABLE)
HOME_OFFICE = "fez_home_office"
CARE_SOUGHT = "buscou_atendimento_saude"
AWAY_REASON = "motivo_afastamento"
BEHAVIOUR_LABELS = (
    "Ficou rigorosamente em casa",
    "Buscou atendimento de saúde",
    "Home office (entre ocupados)",
)

# --- fixed values: benefits and income ---------------------------------------------------
AID, AID_AMOUNT, FAMILY_AID = (
    "recebeu_auxilio_emergencial", "valor_auxilio_emergencial", "recebeu_bolsa_familia",
)
INCOME = "renda_efetiva_trabalho_principal"
HAS_INCOME = "ind_tem_renda_efetiva"
INCOME_LABELS = {1: "Com renda efetiva", 0: "Sem renda efetiva"}
OVERLAP_LABELS = (
    "Auxílio Emergencial + Bolsa Família", "Só Auxílio Emergencial", "Só Bolsa Família",
    "Nenhum dos dois",
)
SPEC_OVERLAP_LABELS = ("AE + BF", "Só AE", "Só BF", "Nenhum")
INCOME_CAP = 8000
INCOME_BINS = 60
MINIMUM_WAGE = 1045.0
HAS_SYMPTOM = "ind_teve_sintoma_gripal"
SYMPTOM_COUNT = "qtd_sintomas_relatados"
BREATHING = "sintoma_dificuldade_respirar"

# --- fixed values: star schema -------------------------------------------------------------
BLOCK_TABLES = {
    "base_saude": "saude",
    "base_comportamento": "comportamento",
    "base_economico": "economico",
    "base_trabalho": "trabalho",
}
ID_BLOCKS = ("id", "peso")
PROFILE_BLOCK = "perfil"
LOCATION_COLUMNS = ("situacao_domicilio", "mora_na_capital", "mora_em_regiao_metropolitana")
PUBLISHED_DICTIONARY_COLUMNS = (
    "codigo_variavel", "nome_semantico", "descricao_variavel", "bloco", "tipo", "dominio",
    "parte", "meses",
)
# The household weight is declared an integer but carries decimals in the data.
TYPE_OVERRIDES = {"peso_domicilio_pessoas": "double"}

# --- fixed values: reports and KPI tables ----------------------------------------------------
# Slug and title of each report, in order.
REPORTS = {
    "01_evolucao_geral_sintomas_gripais": "Evolução geral de sintomas gripais por mês",
    "02_sintomas_gripais_por_regiao": "Sintomas gripais por região",
    "03_sintomas_por_faixa_etaria": "Sintomas por faixa etária",
    "04_gravidade_dificuldade_respirar": "Gravidade clínica: dificuldade para respirar",
    "05_sintomas_com_comorbidades": "População com sintomas e comorbidades",
    "06_busca_atendimento_saude": "Busca por atendimento de saúde",
    "07_local_atendimento": "Onde a população buscou atendimento",
    "08_isolamento_rigoroso_por_mes": "Isolamento rigoroso por mês",
    "09_home_office_por_regiao": "Home office por região",
    "10_situacao_mercado_trabalho": "Situação do mercado de trabalho",
    "11_dependencia_auxilio_emergencial": "Dependência de auxílio emergencial",
    "12_renda_efetiva_media_por_regiao": "Renda efetiva média por região",
    "13_insights_prevencao_proximo_surto": "Insights para prevenção de próximo surto de COVID",
}
# Description and group of each KPI.
KPI_TEXTS = {
    "test_taken": ("Realizou teste", "testagem"),
    "test_result": ("Resultado Positivo", "testagem"),
    "strict": ("Ficou rigorosamente em casa", "protecao"),
    "care_all": ("Buscou atendimento (geral)", "atendimento"),
    "care_cases": ("Buscou atendimento (sintomáticos)", "atendimento"),
    "remote": ("Home office (entre ocupados)", "trabalho"),
    "aid": ("Recebeu Auxílio Emergencial", "beneficio"),
    "family_aid": ("Recebeu Bolsa Família", "beneficio"),
    "unemployment": ("Recebeu Seguro Desemprego", "beneficio"),
    "aid_mean": ("Valor médio Auxílio Emergencial", "renda"),
    "no_income": ("Sem renda efetiva no mês", "renda"),
    "income_mean": ("Média renda efetiva", "renda"),
    "income_median": ("Mediana renda efetiva", "renda"),
    "aid_by_region": ("Auxílio médio - ", "renda_regiao"),
}
