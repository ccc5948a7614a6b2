"""Entity weights and categories as a small dimension table.

The built-in table covers the types that the bundled rules find and the common vendor types; a registry of any size
comes from a file (from_yaml) or as DataFrames (entity_type, weight, category) through the `overrides` parameter: of
system, user and environment overrides, given in this order, the later wins.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_WEIGHT = 5

# Category -> type -> weight.
WEIGHTS_BY_CATEGORY = {
    "direct_identifier": {
        "SSN": 10, "PASSPORT": 10, "DRIVERS_LICENSE": 7, "STATE_ID": 7, "TAX_ID": 8, "AADHAAR": 10, "AADHAAR_IN": 10, "A_NUMBER": 10,
        "GREEN_CARD_NUMBER": 10, "VISA_NUMBER": 8, "I94_NUMBER": 8, "EAD_NUMBER": 8, "NATURALIZATION_NUMBER": 8, "SIN_CA": 10, "NINO_UK": 8,
        "UTR_UK": 8, "INSEE_FR": 8, "PERSONALAUSWEIS_DE": 8, "CODICE_FISCALE_IT": 8, "DNI_ES": 8, "CPF_BR": 10, "RG_BR": 8, "CURP_MX": 8, "PAN_IN": 8,
        "TFN_AU": 8, "MY_NRIC": 8, "CHINA_RESIDENT_ID": 10, "JAPAN_MY_NUMBER": 10, "MEDICARE_ID": 8,
    },
    "health_info": {
        "MRN": 8, "HEALTH_PLAN_ID": 8, "NPI": 7, "DEA": 7, "DIAGNOSIS": 8, "MEDICATION": 6, "LAB_TEST": 5, "ENCOUNTER_ID": 5, "ACCESSION_ID": 5,
        "PHARMACY_ID": 5, "PATIENT_ACCOUNT": 6, "DATE_MEDICAL": 3, "MBI": 8, "HICN": 8, "NHS_NUMBER": 8, "NAME_PATIENT": 8, "NAME_PROVIDER": 4,
        "PAYER": 2, "ROOM": 2, "MEDICAL_LICENSE": 5,
    },
    "financial": {
        "CREDIT_CARD": 10, "BANK_ACCOUNT": 7, "BANK_ROUTING": 6, "IBAN": 7, "SWIFT_BIC": 5, "CUSIP": 5, "ISIN": 5, "SEDOL": 5, "FIGI": 5, "LEI": 5,
        "BITCOIN_ADDRESS": 8, "ETHEREUM_ADDRESS": 8, "CRYPTO_SEED_PHRASE": 10, "SOLANA_ADDRESS": 8, "CARDANO_ADDRESS": 8, "LITECOIN_ADDRESS": 8,
        "DOGECOIN_ADDRESS": 8, "XRP_ADDRESS": 8, "MORTGAGE_ACCOUNT": 7,
    },
    "contact": {
        "EMAIL": 5, "PHONE": 4, "ADDRESS": 5, "ZIP": 3, "CITY": 2, "STATE": 2, "LOCATION": 3, "FACILITY": 4, "URL": 3,
    },
    "quasi_identifier": {
        "NAME": 5, "NAME_RELATIVE": 7, "DATE_DOB": 6, "DOB": 6, "DATE": 3, "TIME": 2, "DATETIME": 3, "AGE": 4, "GENDER": 2, "RACE_ETHNICITY": 4,
        "ETHNICITY": 4, "RELIGION": 4, "SEXUAL_ORIENTATION": 5, "EMPLOYER": 4, "PROFESSION": 3, "EMPLOYEE_ID": 5, "UNIQUE_ID": 5,
    },
    "digital_identifier": {
        "IP_ADDRESS": 4, "MAC_ADDRESS": 4, "DEVICE_ID": 5, "IMEI": 6, "USERNAME": 5, "VIN": 5, "BIOMETRIC_ID": 8, "IMAGE_ID": 4, "TRACKING_NUMBER": 2,
        "LICENSE_PLATE": 5, "IMSI": 7, "ICCID": 6, "MSISDN": 6, "MEID": 6, "ESN": 5,
    },
    "classification_marking": {
        "CLASSIFICATION_LEVEL": 8, "CLASSIFICATION_MARKING": 10, "SCI_MARKING": 10, "DISSEMINATION_CONTROL": 8, "CLEARANCE_LEVEL": 7,
        "ITAR_MARKING": 8, "EAR_MARKING": 7, "CAGE_CODE": 4, "DUNS_NUMBER": 4, "UEI": 4, "DOD_CONTRACT": 5, "GSA_CONTRACT": 4,
    },
    "education": {
        "STUDENT_ID": 7, "TRANSCRIPT": 7, "ENROLLMENT_ID": 6, "FINANCIAL_AID_ID": 7, "SCHOOL_RECORD": 6, "GPA": 5, "DISCIPLINARY_RECORD": 7,
        "IEP_ID": 8, "TEACHER_ID": 5, "FERPA_DIRECTORY_INFO": 4,
    },
    "legal": {
        "CASE_NUMBER": 6, "BAR_NUMBER": 5, "COURT_ID": 4, "PACER_ID": 6, "INMATE_NUMBER": 7, "PROBATION_ID": 7, "ARREST_RECORD": 8,
        "WARRANT_NUMBER": 7, "JUDGMENT_ID": 6, "LEGAL_HOLD_ID": 5,
    },
    "vehicle": {
        "REGISTRATION_NUMBER": 5, "TITLE_NUMBER": 5, "DOT_NUMBER": 4, "MC_NUMBER": 4, "VESSEL_ID": 5, "AIRCRAFT_TAIL": 5, "PILOT_LICENSE": 6,
        "CDL_NUMBER": 7, "TOLL_ACCOUNT": 4,
    },
    "immigration": {
        "SEVIS_ID": 7, "TRAVEL_DOCUMENT_NUMBER": 8, "PETITION_NUMBER": 6,
    },
    "insurance": {
        "POLICY_NUMBER": 6, "CLAIM_NUMBER": 6, "AGENT_NUMBER": 4, "ADJUSTER_ID": 4, "NAIC_NUMBER": 3, "AUTO_POLICY_ID": 6, "HOME_POLICY_ID": 6,
        "LIFE_POLICY_ID": 7, "WORKERS_COMP_CLAIM": 7, "DISABILITY_CLAIM_ID": 7,
    },
    "credential": {
        "PASSWORD": 10, "API_KEY": 10, "SECRET": 10, "PRIVATE_KEY": 10, "JWT": 8, "BEARER_TOKEN": 8, "DATABASE_URL": 10, "AWS_ACCESS_KEY": 10,
        "GOOGLE_API_KEY": 10, "GITHUB_TOKEN": 10, "SLACK_TOKEN": 10, "STRIPE_KEY": 10, "BASIC_AUTH": 10, "AWS_SECRET_KEY": 10,
        "AZURE_STORAGE_KEY": 10, "REDIS_URL": 10,
    },
}
WEIGHTS = {t: (w, c) for c, row in WEIGHTS_BY_CATEGORY.items() for t, w in row.items()}
HIGH_RISK = 8

# Vendor names -> types.
ALIASES = {
    "USA_SOCIAL_SECURITY_NUMBER": "SSN", "US_SOCIAL_SECURITY_NUMBER": "SSN", "US_SSN": "SSN", "SOCIAL_SECURITY_NUMBER": "SSN", "U.S. SOCIAL SECURITY NUMBER (SSN)": "SSN",
    "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "CREDIT_CARD_NUMBER": "CREDIT_CARD", "IBAN_CODE": "IBAN", "US_PASSPORT": "PASSPORT", "USA_PASSPORT_NUMBER": "PASSPORT",
    "PERSON": "NAME", "PERSON_NAME": "NAME", "DATE_OF_BIRTH": "DATE_DOB", "DOB": "DATE_DOB", "STREET_ADDRESS": "ADDRESS", "US_BANK_NUMBER": "BANK_ACCOUNT",
    "US_DRIVER_LICENSE": "DRIVERS_LICENSE", "DRIVER_LICENSE": "DRIVERS_LICENSE", "AWS_CREDENTIALS": "AWS_ACCESS_KEY", "DATE_TIME": "DATETIME", "MEDICAL_RECORD_NUMBER": "MRN",
}

# Types of clinical context, which detection drops.
CLINICAL = ("LAB_TEST", "DIAGNOSIS", "MEDICATION", "DRUG", "PROCEDURE", "PAYER", "PHYSICAL_DESC")


def dimension(spark: SparkSession, *overrides: DataFrame | None) -> DataFrame:
    """entity_type, weight, category; of rows for one type those of the last table win, in a table those with the largest weight."""
    out = spark.createDataFrame([(t, w, c) for t, (w, c) in sorted(WEIGHTS.items())], "entity_type string, weight int, category string").withColumn("_at", F.lit(0))
    for at, table in enumerate([x for x in overrides if x is not None], 1):
        category = F.col("category") if "category" in table.columns else F.lit(None).cast("string")
        out = out.unionByName(table.select(F.upper(F.trim("entity_type")).alias("entity_type"), F.col("weight").cast("int").alias("weight"), category.alias("category"), F.lit(at).alias("_at")).where("weight between 1 and 10"))
    best = out.groupBy("entity_type").agg(F.max(F.struct("_at", "weight")).alias("w"), F.max_by("category", F.when(F.col("category").isNotNull(), F.col("_at"))).alias("category"))
    return best.select("entity_type", F.col("w.weight").alias("weight"), F.coalesce("category", F.lit("unknown")).alias("category"))


def from_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A registry file, `category:` lines with indented `TYPE: weight` lines, as entity_type, weight, category; other weights than 1 to 10 are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^([A-Za-z_][\w]*:[ ]*(?:#[^\n]*)?(?:\n(?:[ \t]+[^\n]*|#[^\n]*|))*)"), F.lit(1))).alias("block"))
    rows = whole.select(F.regexp_extract("block", r"^([A-Za-z_]\w*):", 1).alias("category"), F.explode(F.regexp_extract_all("block", F.lit(r"(?m)^[ \t]+([A-Za-z_]\w*:[ \t]*[0-9]+)[ \t]*(?:#.*)?$"), F.lit(1))).alias("row"))
    parts = F.split("row", r":[ \t]*")
    return rows.select(F.upper(F.get(parts, 0)).alias("entity_type"), F.get(parts, 1).cast("int").alias("weight"), "category").where("weight between 1 and 10")


def categories(table: DataFrame) -> DataFrame:
    return table.select("category").distinct()


def types_in(table: DataFrame, category: str) -> DataFrame:
    return table.where(F.col("category") == category).select("entity_type")


def high_risk(table: DataFrame, least: int = HIGH_RISK) -> DataFrame:
    return table.where(F.col("weight") >= least).select("entity_type", "weight")


def is_known(entity_type: Column) -> Column:
    """Whether a type has a weight of its own."""
    return F.upper(F.trim(entity_type)).isin(*WEIGHTS)


def _map(items: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(items.items())])


def canonical(vendor: Column) -> Column:
    """Vendor type -> type: a known type wins, then an alias, else the name itself, upper-cased."""
    name = F.upper(F.trim(vendor))
    return F.when(name.isin(*WEIGHTS), name).otherwise(F.coalesce(F.element_at(_map(ALIASES), name), name))


def weight_of(entity_type: Column) -> Column:
    return F.coalesce(F.element_at(_map({t: w for t, (w, _) in WEIGHTS.items()}), entity_type), F.lit(DEFAULT_WEIGHT))


def category_of(entity_type: Column) -> Column:
    return F.coalesce(F.element_at(_map({t: c for t, (_, c) in WEIGHTS.items()}), entity_type), F.lit("unknown"))
