"""Vocabulary of the case records.

Everything in this module is a fixed value: code books, labels, column lists
and texts which results must reproduce exactly. No logic lives here.
"""

# ---- fixed values: years and age bands (lower bound inclusive, upper exclusive) ----
SUPPORTED_YEARS = (2019, 2020, 2021, 2022, 2023, 2024, 2025, 2026)

AGE_BANDS = (
    (0.0, 1.0, "<1"),
    (1.0, 5.0, "1-4"),
    (5.0, 12.0, "5-11"),
    (12.0, 18.0, "12-17"),
    (18.0, 30.0, "18-29"),
    (30.0, 45.0, "30-44"),
    (45.0, 60.0, "45-59"),
    (60.0, 75.0, "60-74"),
    (75.0, None, "75+"),
)

# ---- fixed values: exploratory age bands (lower bound exclusive, upper inclusive) ----
EXPLORATORY_AGE_BANDS = (
    ("0-12", 0, 12),
    ("13-18", 12, 18),
    ("19-30", 18, 30),
    ("31-45", 30, 45),
    ("46-60", 45, 60),
    ("61-75", 60, 75),
    ("76+", 75, 120),
)

# ---- fixed values: columns every yearly file must carry ----
REQUIRED_COLUMNS = ("TP_IDADE", "NU_IDADE_N", "SG_UF", "ID_MUNICIP", "EVOLUCAO", "UTI")

# ---- fixed values: texts that a raw file uses for "no value" ----
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# ---- fixed values: characters that count as blank at either end of a name ----
BLANKS = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ---- fixed values: code books ----
OUTCOME_LABELS = {1: "CURA", 2: "OBITO_SRAG", 3: "OBITO_OUTRAS_CAUSAS", 9: "IGNORADO"}
OUTCOME_OTHER = "OUTRO"
YES_NO_LABELS = {1: "SIM", 2: "NAO"}
IGNORED = "IGNORADO"
ABSENT = "AUSENTE"

FINAL_CLASSIFICATION_LABELS = {
    1: "INFLUENZA",
    2: "OUTRO_VIRUS_RESPIRATORIO",
    3: "OUTRO_AGENTE_ETIOLOGICO",
    4: "NAO_ESPECIFICADO",
    5: "COVID-19",
}
CLASSIFICATION_OTHER = "OUTRO"

# First positive test in this order names the agent.
LAB_AGENTS = {
    "PCR_SARS2": "SARS-CoV-2",
    "PCR_FLUAS": "Influenza A",
    "PCR_FLUBS": "Influenza B",
    "PCR_VSR": "VSR",
    "PCR_ADENO": "Adenovirus",
    "PCR_PARA1": "Parainfluenza 1",
    "PCR_PARA2": "Parainfluenza 2",
    "PCR_PARA3": "Parainfluenza 3",
    "PCR_PARA4": "Parainfluenza 4",
    "PCR_METAP": "Metapneumovirus",
    "PCR_BOCA": "Bocavirus",
    "PCR_RINO": "Rinovirus",
}
NO_AGENT = "NAO_IDENTIFICADA"

COMORBIDITIES = {
    "CARDIOPATI": "CARDIOPATIA",
    "DIABETES": "DIABETES",
    "OBESIDADE": "OBESIDADE",
    "RENAL": "DOENCA_RENAL",
    "HEPATICA": "DOENCA_HEPATICA",
    "IMUNODEPRE": "IMUNODEPRESSAO",
    "ASMA": "ASMA",
    "PNEUMOPATI": "PNEUMOPATIA",
    "NEUROLOGIC": "DOENCA_NEUROLOGICA",
    "HEMATOLOGI": "DOENCA_HEMATOLOGICA",
}

# ---- fixed values: outcome and intensive-care groups behind the ratios ----
DEATH = "OBITO_SRAG"
KNOWN_OUTCOMES = ("CURA", "OBITO_SRAG", "OBITO_OUTRAS_CAUSAS")
UNKNOWN_OUTCOMES = ("IGNORADO", "AUSENTE", "OUTRO")
ICU_YES = "SIM"
KNOWN_ICU = ("SIM", "NAO")
UNKNOWN_ICU = ("IGNORADO", "AUSENTE")

# ---- fixed values: labels of the exploratory tables ----
EXPLORATORY_OUTCOME_LABELS = {1: "Cura", 2: "Óbito", 3: "Óbito (outras causas)", 9: "Ignorado"}
OBESITY_LABELS = {1: "Obeso", 2: "Não obeso"}
ICU_LABELS = {1: "Sim", 2: "Não"}
EXPLORATORY_DATES = ("DT_NOTIFIC", "DT_SIN_PRI", "DT_EVOLUCA", "DT_INTERNA", "DT_ENTUTI")
EXPLORATORY_COMORBIDITIES = (
    "CARDIOPATI", "DIABETES", "OBESIDADE", "PNEUMOPATI", "RENAL", "HEPATICA", "NEUROLOGIC", "ASMA",
)
STATE_COLUMNS = ("SG_UF", "SG_UF_NOT")

# ---- fixed values: columns kept in the reduced file, in file order ----
REDUCED_COLUMNS = (
    "DT_SIN_PRI", "DT_INTERNA", "DT_ENTUTI", "DT_SAIDUTI", "DT_EVOLUCA",
    "CS_SEXO", "NU_IDADE_N", "TP_IDADE", "CS_RACA", "CS_ESCOL_N", "CS_GESTANT", "PUERPERA",
    "SG_UF_NOT",
    "FEBRE", "TOSSE", "GARGANTA", "DISPNEIA", "DESC_RESP", "SATURACAO", "DIARREIA", "VOMITO",
    "DOR_ABD", "FADIGA", "PERD_OLFT", "PERD_PALA", "OUTRO_SIN",
    "CARDIOPATI", "HEMATOLOGI", "SIND_DOWN", "HEPATICA", "ASMA", "DIABETES", "NEUROLOGIC",
    "PNEUMOPATI", "IMUNODEPRE", "RENAL", "OBESIDADE", "TABAG", "OUT_MORBI",
    "HOSPITAL", "UTI", "SUPORT_VEN", "EVOLUCAO",
    "CLASSI_FIN", "CRITERIO", "PCR_RESUL", "PCR_SARS2",
)

# ---- fixed values: admission model features and the columns that would leak the outcome ----
DEMOGRAPHIC_FEATURES = ("CS_SEXO", "NU_IDADE_N", "CS_GESTANT")
SYMPTOM_FEATURES = (
    "FEBRE", "TOSSE", "GARGANTA", "DISPNEIA", "DESC_RESP", "SATURACAO", "DIARREIA", "VOMITO",
    "DOR_ABD", "FADIGA", "PERD_OLFT", "PERD_PALA", "OUTRO_SIN",
)
COMORBIDITY_FEATURES = (
    "CARDIOPATI", "DIABETES", "PNEUMOPATI", "RENAL", "HEPATICA", "IMUNODEPRE", "OBESIDADE",
    "OUT_MORBI", "FATOR_RISC",
)
GEOGRAPHIC_FEATURES = ("SG_UF", "REGIAO")
TEMPORAL_FEATURES = ("SINT_ATE_NOTIF",)
LEAKAGE_FEATURES = (
    "EVOLUCAO", "DESFECHO_NORMALIZADO", "OBITO_SRAG", "DT_EVOLUCA", "UTI", "SUPORT_VEN",
    "QTD_DIAS", "DIAS_INTERNA", "PCR_EVOLUCAO",
)
ADMISSION_METADATA = ("ANO", "SG_UF", "DT_NOTIFIC")
ADMISSION_TARGET = {"CURA": 0, "OBITO_SRAG": 1}

# ---- fixed values: features of the state-level benchmark ----
STATE_MODEL_FEATURES = (
    "NU_IDADE_N", "CS_SEXO", "CS_RACA", "CS_ESCOL_N", "VACINA_COV", "FEBRE", "TOSSE", "GARGANTA",
    "DISPNEIA", "DESC_RESP", "SATURACAO", "DIARREIA", "VOMITO", "CARDIOPATI", "DIABETES",
    "OBESIDADE", "PNEUMOPATI", "RENAL", "HEPATICA", "NEUROLOGIC", "ASMA", "PUERPERA", "SG_UF_NOT",
)

# ---- fixed values: features of the patient-level benchmark ----
PATIENT_NUMERIC = ("NU_IDADE_N",)
PATIENT_YES_NO = (
    "FEBRE", "TOSSE", "GARGANTA", "DISPNEIA", "DESC_RESP", "SATURACAO", "DIARREIA", "VOMITO",
    "CARDIOPATI", "PNEUMOPATI", "RENAL", "OBESIDADE", "DIABETES", "HEMATOLOGI", "HEPATICA",
    "ASMA", "IMUNODEPRE", "NEUROLOGIC", "PUERPERA", "SIND_DOWN", "UTI", "SUPORT_VEN",
)
PATIENT_NOMINAL = ("CS_SEXO", "CS_RACA", "CS_ESCOL_N", "SG_UF_NOT")
PATIENT_YES_NO_FILL = "9"
PATIENT_NOMINAL_FILL = "DESCONHECIDO"

# ---- fixed values: region of every Brazilian state ----
STATE_REGIONS = {
    "AC": "NORTE", "AM": "NORTE", "AP": "NORTE", "PA": "NORTE", "RO": "NORTE", "RR": "NORTE",
    "TO": "NORTE",
    "AL": "NORDESTE", "BA": "NORDESTE", "CE": "NORDESTE", "MA": "NORDESTE", "PB": "NORDESTE",
    "PE": "NORDESTE", "PI": "NORDESTE", "RN": "NORDESTE", "SE": "NORDESTE",
    "DF": "CENTRO-OESTE", "GO": "CENTRO-OESTE", "MS": "CENTRO-OESTE", "MT": "CENTRO-OESTE",
    "ES": "SUDESTE", "MG": "SUDESTE", "RJ": "SUDESTE", "SP": "SUDESTE",
    "PR": "SUL", "RS": "SUL", "SC": "SUL",
}

# ---- fixed values: columns that hold a numeric code or a number written as text ----
CODED_COLUMNS = tuple(
    dict.fromkeys(
        ("TP_IDADE", "NU_IDADE_N", "EVOLUCAO", "UTI", "CLASSI_FIN", "CO_MUN_RES", "SEM_PRI",
         "CS_RACA", "CS_ESCOL_N", "CS_GESTANT", "VACINA_COV", "PUERPERA", "SIND_DOWN", "TABAG",
         "HOSPITAL", "SUPORT_VEN", "CRITERIO", "PCR_RESUL")
        + tuple(LAB_AGENTS)
        + tuple(COMORBIDITIES)
        + SYMPTOM_FEATURES
        + ("OUT_MORBI", "FATOR_RISC")
    )
)
