"""The rule catalog: (type, pattern, group, confidence, validator), written from public formats.

Patterns are valid for both Java and Python, so counts can stay in the JVM and offsets come from an Arrow UDF.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    """hints: lower-cased pieces of text, one of which stands in every text that the pattern matches in; none: unknown."""

    type: str
    pattern: str
    group: int = 0
    confidence: float = 0.9
    tier: int = 2
    validator: str | None = None
    hints: tuple[str, ...] = ()


PATTERN, STRUCTURED, CHECKSUM = 2, 3, 4


def _labelled(type_: str, label: str, value: str, confidence: float = 0.92) -> Rule:
    """A value behind its label; the letters that a label starts with are its hint."""
    return Rule(type_, rf"(?i)\b(?:{label})\s*(?:number|no\.?|id|#)?\s*[:#=]?\s*({value})\b", 1, confidence, STRUCTURED, None, _starts(label))


def _starts(label: str) -> tuple[str, ...]:
    """The letters that each way of writing a label starts with, without one that may be left out."""
    found = [re.match(r"[A-Za-z]*", way)[0] + way[len(re.match(r"[A-Za-z]*", way)[0]):][:1] for way in re.split(r"\|(?![^(]*\))", label)]
    return tuple((x[:-2] if x.endswith("?") else re.match(r"[A-Za-z]*", x)[0]).lower() for x in found)


RULES = (
    Rule("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0, 0.99, CHECKSUM, "ssn"),
    Rule("CREDIT_CARD", r"(?<![0-9A-Za-z])[3-6](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])", 0, 0.99, CHECKSUM, "card"),
    Rule("NPI", r"(?i)\bNPI\s*[:#]?\s*([12][0-9]{9})\b", 1, 0.95, CHECKSUM, "npi", ("npi",)),
    Rule("DEA", r"\b[A-Z]{2}[0-9]{7}\b", 0, 0.95, CHECKSUM, "dea"),
    Rule("IBAN", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", 0, 0.98, CHECKSUM, "iban"),
    Rule("VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", 0, 0.96, CHECKSUM, "vin"),
    Rule("EMAIL", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,190}\.[A-Za-z]{2,24}", 0, 0.96),
    Rule("PHONE", r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", 0, 0.9, PATTERN, "phone"),
    Rule("IP_ADDRESS", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", 0, 0.9, PATTERN, "ipv4"),
    Rule("MAC_ADDRESS", r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b", 0, 0.95, PATTERN, None, (":", "-")),
    Rule("URL", r"\bhttps?://[^\s<>\"')\]]{3,2000}", 0, 0.9),
    Rule("DATE", r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])", 0, 0.85, PATTERN, "iso_date"),
    Rule("DATE", r"(?<![0-9/])[01]?[0-9]/[0-3]?[0-9]/(?:19|20)[0-9]{2}(?![0-9/])", 0, 0.8, PATTERN, "us_date"),
    Rule("TIME", r"(?i)\b(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?(?: ?[ap]m)?\b", 0, 0.82),
    Rule("DATE_DOB", r"(?i)\b(?:DOB|date of birth|born)\s*[:=]?\s*([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4})", 1, 0.95, STRUCTURED, None, ("dob", "birth", "born")),
    Rule("AGE", r"(?i)\b(?:age|aged)\s*[:=]?\s*([0-9]{1,3})\b", 1, 0.9, PATTERN, "age"),
    Rule("AGE", r"(?i)\b([0-9]{1,3})[ -]?(?:years?|yrs?)[ -]old\b", 1, 0.92, PATTERN, "age"),
    Rule("ZIP", r"\b(?:A[KLRZ]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY]) ([0-9]{5}(?:-[0-9]{4})?)\b", 1, 0.9),
    Rule("ADDRESS", r"\b[0-9]{1,6} (?:[A-Z][A-Za-z]+ ){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl)\b\.?", 0, 0.88),
    Rule("NAME", r"\b(?:Mr|Mrs|Ms|Miss)\.? ([A-Z][a-z]+(?: [A-Z][a-z]+){0,2})", 1, 0.85),
    Rule("NAME_PROVIDER", r"\bDr\.? ([A-Z][a-z]+(?: [A-Z][a-z]+){0,2})", 1, 0.9),
    Rule("NAME_PATIENT", r"(?i)\bpatient(?: name)?\s*:\s*([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})", 1, 0.92, STRUCTURED, None, ("patient",)),
    Rule("CUSIP", r"(?i)\bCUSIP\s*[:#]?\s*([0-9A-Z*@#]{8}[0-9])\b", 1, 0.98, CHECKSUM, "cusip", ("cusip",)),
    Rule("ISIN", r"\b[A-Z]{2}[A-Z0-9]{9}[0-9]\b", 0, 0.85, CHECKSUM, "isin"),
    Rule("SEDOL", r"(?i)\bSEDOL\s*[:#]?\s*([0-9BCDFGHJ-NP-TV-Z]{6}[0-9])\b", 1, 0.98, CHECKSUM, "sedol", ("sedol",)),
    Rule("LEI", r"(?i)\bLEI\s*[:#]?\s*([A-Z0-9]{18}[0-9]{2})\b", 1, 0.98, CHECKSUM, "lei", ("lei",)),
    Rule("FIGI", r"\bBBG[0-9A-Z]{9}\b", 0, 0.95),
    Rule("SWIFT_BIC", r"(?i)\b(?:SWIFT|BIC)\s*[:#]?\s*([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", 1, 0.98, PATTERN, None, ("swift", "bic")),
    Rule("BANK_ROUTING", r"(?i)\b(?:routing|ABA)\s*(?:number|no\.?|#)?\s*[:#]?\s*([0-9]{9})\b", 1, 0.9, CHECKSUM, "aba", ("routing", "aba")),
    Rule("ETHEREUM_ADDRESS", r"\b0x[0-9a-fA-F]{40}\b", 0, 0.98),
    Rule("BITCOIN_ADDRESS", r"\bbc1[qpzry9x8gf2tvdw0s3jn54khce6mua7l]{11,71}\b", 0, 0.95, PATTERN, None, ("bc1",)),
    Rule("CLASSIFICATION_MARKING", r"\b(?:TOP SECRET|SECRET|CONFIDENTIAL)//[A-Z/ -]{2,40}", 0, 0.98),
    Rule("CLASSIFICATION_LEVEL", r"(?i)\bclassification\s*:\s*(top secret|secret|confidential|unclassified)\b", 1, 0.95, STRUCTURED, None, ("classification",)),
    Rule("DISSEMINATION_CONTROL", r"\b(?:NOFORN|ORCON|REL TO [A-Z]{3}(?:, ?[A-Z]{3})*|FOUO)\b", 0, 0.95, PATTERN, None, ("noforn", "orcon", "rel to", "fouo")),
    Rule("CLEARANCE_LEVEL", r"(?i)\b(?:TS/SCI|top secret|secret|confidential) clearance\b", 0, 0.95, PATTERN, None, ("clearance",)),
    Rule("AWS_ACCESS_KEY", r"\bA(?:KI|SI)A[A-Z2-7]{16}\b", 0, 0.99, PATTERN, None, ("akia", "asia")),
    Rule("GITHUB_TOKEN", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b", 0, 0.99, PATTERN, None, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("GOOGLE_API_KEY", r"\bAIza[0-9A-Za-z_-]{35}", 0, 0.99),
    Rule("SLACK_TOKEN", r"\bxox[abprs]-[0-9A-Za-z-]{10,250}", 0, 0.99),
    Rule("STRIPE_KEY", r"\b[rs]k_live_[0-9A-Za-z]{16,250}\b", 0, 0.99),
    Rule("JWT", r"\beyJ[A-Za-z0-9_-]{8,2000}\.eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,2000}", 0, 0.98),
    Rule("PRIVATE_KEY", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 0.99),
    Rule("DATABASE_URL", r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:@/]{1,100}:[^\s@]{1,200}@[^\s]{1,300}", 0, 0.98),
    Rule("SECRET", r"(?i)\b(?:token|secret|api_?key)\s*[:=]\s*[\"']?([0-9A-Za-z_/+-]{16,200})", 1, 0.9, PATTERN, None, ("token", "secret", "api")),
    Rule("PASSWORD", r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*[\"']?([^\s\"']{6,128})", 1, 0.9, PATTERN, None, ("passw", "pwd")),
    _labelled("MRN", "MRN|medical record", "[A-Z]{0,3}[0-9]{5,12}", 0.95),
    _labelled("HEALTH_PLAN_ID", "health plan|member|subscriber", "[A-Z]{0,4}[0-9]{6,14}", 0.88),
    _labelled("PASSPORT", "passport", "[A-Z]{0,2}[0-9]{6,9}", 0.88),
    _labelled("DRIVERS_LICENSE", "driver'?s? licen[sc]e|DL", "[A-Z]{0,2}[0-9]{5,13}", 0.88),
    _labelled("STUDENT_ID", "student", "[A-Z]{0,2}[0-9]{5,10}"),
    _labelled("CASE_NUMBER", "case", "[0-9]{1,2}[:-][0-9]{2}-[a-z]{2}-[0-9]{3,6}", 0.95),
    _labelled("EMPLOYEE_ID", "employee", "[A-Z]{0,3}[0-9]{4,10}", 0.82),
    _labelled("CLAIM_NUMBER", "claim", "[A-Z]{0,3}[0-9]{6,14}", 0.88),
    _labelled("POLICY_NUMBER", "policy", "[A-Z]{0,4}[0-9]{6,14}", 0.88),
    _labelled("ENCOUNTER_ID", "encounter|visit", "[A-Z]{0,3}[0-9]{5,12}", 0.9),
    _labelled("CAGE_CODE", "CAGE(?: code)?", "[0-9][0-9A-Z]{3}[0-9]", 0.98),
    _labelled("GPA", "GPA", r"[0-4]\.[0-9]{1,2}"),
    _labelled("NHS_NUMBER", "NHS", "[0-9]{3} ?[0-9]{3} ?[0-9]{4}"),
    _labelled("A_NUMBER", "alien registration|A", "A-?[0-9]{7,9}", 0.98),
    Rule("EMPLOYER", r"\b(?i:employer|employed by|works? (?:at|for))\s*:?\s+([A-Z][\w&.-]*(?: [A-Z][\w&.-]*){0,4})", 1, 0.82, PATTERN, None, ("employe", "work")),
    Rule("NAME_RELATIVE", r"\b(?i:mother|father|wife|husband|spouse|son|daughter|brother|sister|guardian|next of kin)\s*[:,]\s*([A-Z][a-z]+(?: [A-Z][a-z]+){1,2})", 1, 0.85, PATTERN, None, ("mother", "father", "wife", "husband", "spouse", "son", "daughter", "brother", "sister", "guardian", "next of kin")),
    Rule("FACILITY", r"\b((?:[A-Z][a-z.']+ ){1,4}(?:Hospital|Medical Center|Clinic|Health Center|Nursing Home|Hospice|Infirmary))\b", 1, 0.88, PATTERN, None, ("hospital", "medical center", "clinic", "health center", "nursing home", "hospice", "infirmary")),
    Rule("SOLANA_ADDRESS", r"(?i:\bsol(?:ana)?\b)[^1-9A-HJ-NP-Za-km-z]{1,20}(?:(?i:address|wallet)\W{1,3})?([1-9A-HJ-NP-Za-km-z]{32,44})\b", 1, 0.85, PATTERN, None, ("sol",)),
    Rule("CARDANO_ADDRESS", r"\baddr1[02-9ac-hj-np-z]{50,110}\b", 0, 0.95, PATTERN, None, ("addr1",)),
    Rule("LITECOIN_ADDRESS", r"\bltc1[02-9ac-hj-np-z]{20,75}\b", 0, 0.95, PATTERN, None, ("ltc1",)),
    Rule("LITECOIN_ADDRESS", r"(?i:\blitecoin\b\W{1,4}(?:address\W{1,3})?)([LM][1-9A-HJ-NP-Za-km-z]{26,33})\b", 1, 0.85, PATTERN, None, ("litecoin",)),
    Rule("DOGECOIN_ADDRESS", r"\bD[5-9A-HJ-NP-U][1-9A-HJ-NP-Za-km-z]{32}\b", 0, 0.80),
    Rule("XRP_ADDRESS", r"(?i:\b(?:xrp|ripple)\b\W{1,4}(?:address\W{1,3})?)(r[1-9A-HJ-NP-Za-km-z]{24,34})\b", 1, 0.80, PATTERN, None, ("xrp", "ripple")),
    Rule("CRYPTO_SEED_PHRASE", r"(?i)\b(?:seed|recovery|mnemonic)(?: phrase)?\s*[:=]\s*((?:[a-z]{3,8} ){11}(?:(?:[a-z]{3,8} ){12})?[a-z]{3,8})\b", 1, 0.95, STRUCTURED, None, ("seed", "recovery", "mnemonic")),
    Rule("SCI_MARKING", r"\b(?:TS//SCI|SECRET//SI|TOP SECRET//SI)(?:/[A-Z]{2,4})*\b|//(?:SI|TK|HCS|G|COMINT)(?:/[A-Z]{2,6})*//", 0, 0.95, PATTERN, None, ("//s", "//t", "//h", "//g", "//c")),
    Rule("ITAR_MARKING", r"(?i)\b(?:ITAR[- ](?:controlled|restricted)|subject to (?:the )?ITAR|22 CFR (?:parts? )?12[0-9])\b", 0, 0.95, PATTERN, None, ("itar", "22 cfr")),
    Rule("EAR_MARKING", r"(?i)\b(?:ECCN\s*:?\s*[0-9][A-E][0-9]{3}|subject to (?:the )?EAR|EAR99|15 CFR (?:parts? )?7[3-7][0-9])\b", 0, 0.93, PATTERN, None, ("eccn", "subject to", "ear99", "15 cfr")),
    Rule("DOD_CONTRACT", r"\b(?:[WNF][A-Z0-9]{5}|FA[0-9]{4}|HQ[0-9]{4})-?[0-9]{2}-?[A-Z]-?[0-9]{4}\b", 0, 0.92),
    Rule("GSA_CONTRACT", r"\b(?:GS-[0-9]{2}[A-Z]-[0-9]{4}[A-Z]|47Q[A-Z]{3}[0-9]{2}[A-Z][0-9A-Z]{4})\b", 0, 0.95, PATTERN, None, ("gs-", "47q")),
    Rule("GPS_COORDINATES", r"(?<![0-9.])-?(?:[0-8]?[0-9]|90)\.[0-9]{4,8},\s*-?(?:1[0-7][0-9]|[0-9]{1,2}|180)\.[0-9]{4,8}(?![0-9])", 0, 0.88),
    Rule("SSN_PARTIAL", r"(?i)\b(?:SSN|social security)[^0-9\n]{0,20}(?:last (?:4|four)|ending in|x{3}-?x{2}-)\s*(?:digits)?\s*:?\s*([0-9]{4})\b", 1, 0.80, PATTERN, None, ("ssn", "social security")),
    Rule("CREDIT_CARD_PARTIAL", r"(?i)\b(?:card|visa|mastercard|amex)[^0-9\n]{0,20}(?:ending in|last (?:4|four)|\*{4}|x{4})\s*(?:digits)?\s*:?[- ]?([0-9]{4})\b", 1, 0.82, PATTERN, None, ("card", "visa", "amex")),
    Rule("SIN", r"(?i)\b(?:SIN|social insurance)\s*(?:number|no\.?|#)?\s*[:#]?\s*([0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3})\b", 1, 0.92, STRUCTURED, None, ("sin", "social insurance")),
    Rule("TFN", r"(?i)\b(?:TFN|tax file)\s*(?:number|no\.?|#)?\s*[:#]?\s*([0-9]{3} ?[0-9]{3} ?[0-9]{2,3})\b", 1, 0.92, STRUCTURED, None, ("tfn", "tax file")),
    Rule("AADHAAR", r"(?i)\b(?:aadhaar|UIDAI)\s*(?:number|no\.?|#)?\s*[:#]?\s*([2-9][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4})\b", 1, 0.92, STRUCTURED, None, ("aadhaar", "uidai")),
    Rule("CURP", r"\b[A-Z]{4}[0-9]{6}[HM][A-Z]{5}[0-9A-Z][0-9]\b", 0, 0.95),
    Rule("SVNR", r"(?i)\b(?:SVNR|sozialversicherungsnummer)\s*[:#]?\s*([0-9]{2} ?[0-9]{6} ?[A-Z] ?[0-9]{3}|[0-9]{4} ?[0-9]{6})\b", 1, 0.92, STRUCTURED, None, ("svnr", "sozialversicherungsnummer")),
    Rule("MEDICARE_ID", r"\b[1-9][AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9][0-9]-?[AC-HJKMNP-RT-Y][AC-HJKMNP-RT-Y0-9][0-9]-?[AC-HJKMNP-RT-Y]{2}[0-9]{2}\b", 0, 0.95),
    Rule("NDC", r"(?i)\bNDC\s*[:#]?\s*([0-9]{4,5}-[0-9]{3,4}-[0-9]{1,2})\b", 1, 0.95, STRUCTURED, None, ("ndc",)),
    Rule("PHONE_EXT", r"(?i)(?<=[0-9])\s*(?:ext\.?|extension|x)\s*([0-9]{2,6})\b", 1, 0.85, PATTERN, None, ("ext", "x")),
    Rule("FAX", r"(?i)\b(?:fax|facsimile)\s*(?:number|no\.?|#)?\s*[:#]?\s*(\+?1?[ .-]?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4})\b", 1, 0.92, STRUCTURED, None, ("fax", "facsimile")),
    Rule("PAGER", r"(?i)\b(?:pager|beeper)\s*(?:number|no\.?|#)?\s*[:#]?\s*((?:\(?[2-9][0-9]{2}\)?[ .-]?)?[0-9]{3}[ .-]?[0-9]{4})\b", 1, 0.90, STRUCTURED, None, ("pager", "beeper")),
    Rule("DATETIME", r"(?<![0-9-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9][T ][0-2][0-9]:[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?(?![0-9])", 0, 0.92),
    Rule("BLOOD_TYPE", r"(?i)\bblood (?:type|group)\s*[:=]?\s*((?:AB|A|B|O)\s?(?:[+-]|pos(?:itive)?|neg(?:ative)?))", 1, 0.92, STRUCTURED, None, ("blood",)),
    Rule("HEIGHT", r"(?i)\b(?:height|hgt)\s*[:=]?\s*([4-7]'\s?(?:1[01]|[0-9])\"?|[12][0-9]{2} ?cm)", 1, 0.90, STRUCTURED, None, ("height", "hgt")),
    Rule("WEIGHT", r"(?i)\b(?:weight|wgt)\s*[:=]?\s*([0-9]{2,3}(?:\.[0-9])? ?(?:lbs?|kg|pounds))\b", 1, 0.88, STRUCTURED, None, ("weight", "wgt")),
    Rule("BMI", r"(?i)\bBMI\s*[:=]?\s*([1-6][0-9](?:\.[0-9]{1,2})?)\b", 1, 0.90, STRUCTURED, None, ("bmi",)),
    Rule("INMATE_NUMBER", r"(?i)\binmate\s*(?:number|no\.?|id|#)?\s*[:#]?\s*([0-9]{5}-[0-9]{3}|[A-Z]?[0-9]{5,8})\b", 1, 0.92, STRUCTURED, None, ("inmate",)),
    Rule("SEVIS_ID", r"\bN[0-9]{10}\b", 0, 0.95),
    Rule("PETITION_NUMBER", r"\b(?:EAC|WAC|LIN|SRC|MSC|NBC|IOE|YSC)[0-9]{10}\b", 0, 0.98),
    Rule("GREEN_CARD_NUMBER", r"(?i)\b(?:green card|permanent resident(?: card)?)\s*(?:number|no\.?|#)?\s*[:#]?\s*([A-Z]{3}[0-9]{10})\b", 1, 0.98, STRUCTURED, None, ("green card", "permanent resident")),
    Rule("EAD_NUMBER", r"(?i)\b(?:EAD|employment authorization)\s*(?:number|no\.?|#)?\s*[:#]?\s*([A-Z]{3}[0-9]{10})\b", 1, 0.98, STRUCTURED, None, ("ead", "employment authorization")),
    Rule("LICENSE_PLATE", r"(?i)\b(?:license plate|plate|tag)\s*(?:number|no\.?|#)?\s*[:#]\s*([A-Z0-9]{2,4}[- ]?[A-Z0-9]{2,5})\b", 1, 0.85, STRUCTURED, None, ("plate", "tag")),
    _labelled("MEMBER_ID", "member", "[A-Z]{0,3}[0-9]{6,12}", 0.85),
    _labelled("DUNS_NUMBER", "DUNS|D-U-N-S", "[0-9]{2}-?[0-9]{3}-?[0-9]{4}", 0.98),
    _labelled("UEI", "UEI|unique entity", "[A-HJ-NP-Z1-9][A-HJ-NP-Z0-9]{11}", 0.97),
    _labelled("ABA_ROUTING", "ABA|RTN", "[0-9]{9}", 0.95),
    _labelled("ACCOUNT_NUMBER", "account|acct", "[0-9]{6,17}", 0.85),
    _labelled("CERTIFICATE_NUMBER", "certificate|cert", "[A-Z]{0,3}[0-9]{5,12}", 0.82),
    _labelled("UNIQUE_ID", "unique identifier|UID", "[A-Z0-9]{6,20}", 0.80),
    _labelled("STATE_ID", "state", "[A-Z]?[0-9]{6,12}", 0.88),
    _labelled("MEDICAL_LICENSE", "medical licen[sc]e", "[A-Z]{0,3}[0-9]{4,10}", 0.88),
    _labelled("MILITARY_ID", "EDIPI|DOD", "[0-9]{10}", 0.92),
    _labelled("ACCESSION_ID", "accession", "[A-Z]{0,3}-?[0-9]{4,12}", 0.90),
    _labelled("PHARMACY_ID", "pharmacy|NCPDP", "[0-9]{7}", 0.90),
    _labelled("ROOM_NUMBER", "room|rm", "[0-9]{1,4}[A-Z]?", 0.88),
    _labelled("BED_NUMBER", "bed", "[0-9]{1,3}[A-Z]?", 0.88),
    _labelled("AUTH_NUMBER", "authorization|prior auth", "[A-Z]{0,3}[0-9]{5,12}", 0.88),
    _labelled("RX_NUMBER", "rx|prescription", "[0-9]{6,9}", 0.88),
    _labelled("ENROLLMENT_ID", "enrollment", "[A-Z]{0,2}[0-9]{5,10}"),
    _labelled("FINANCIAL_AID_ID", "FAFSA|financial aid", "[A-Z]{0,2}[0-9]{6,12}", 0.98),
    _labelled("TRANSCRIPT", "transcript", "[A-Z]{0,2}[0-9]{5,10}", 0.90),
    _labelled("IEP_ID", "IEP", "[A-Z]{0,2}[0-9]{4,10}", 0.95),
    _labelled("TEACHER_ID", "teacher", "[A-Z]{0,2}[0-9]{4,10}", 0.90),
    _labelled("BAR_NUMBER", "state bar|bar", "[0-9]{5,8}"),
    _labelled("PACER_ID", "PACER", "[A-Z]{0,2}[0-9]{5,10}", 0.90),
    _labelled("ARREST_RECORD", "arrest|booking", "[A-Z]{0,2}[0-9]{5,12}", 0.90),
    _labelled("PROBATION_ID", "probation|parole", "[A-Z]{0,2}[0-9]{5,12}", 0.90),
    _labelled("WARRANT_NUMBER", "warrant", "[A-Z]{0,2}[0-9]{5,12}", 0.90),
    _labelled("VISA_NUMBER", "visa", "[A-Z]?[0-9]{8}"),
    _labelled("I94_NUMBER", "I-?94", "[0-9]{9}[A-Z0-9][0-9]", 0.98),
    _labelled("TRAVEL_DOCUMENT_NUMBER", "travel document", "[A-Z]?[0-9]{7,9}", 0.90),
    _labelled("NATURALIZATION_NUMBER", "naturalization(?: certificate)?", "[0-9]{7,9}", 0.95),
)
