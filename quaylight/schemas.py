"""Vocabularies and table schemas. All times are UTC timestamps; missing means unknown, never zero."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values.
INDUSTRIES = ["Electronics", "Manufacturing", "Logistics", "Materials", "Energy", "Other"]
RELATION_TYPES = ["raw_material", "component", "logistics", "manufacturing"]
SOURCES = ["news", "satellite", "viirs", "ais"]
SOURCE_TYPES = ["sec_filing", *SOURCES]
REAL_PROVENANCE = ["sec_filing", "public_source"]
ANNUAL_FORMS = ["10-K", "20-F", "40-F"]
WINDOW_DAYS = {"news": 30, "satellite": 30, "viirs": 120, "ais": 30}
STALE_DAYS = {"viirs": 120, "sec_filing": 365}
ABLATIONS = ["full", "no_vision", "no_news", "no_temporal"]
TARGET = "reported_disruption_within_7d"
FEATURE_SCHEMA = "snapshot-v1"
#: Event rules: type, pattern, severity; then what makes a headline doubtful. Event types and severities must match them.
EVENT_RULES = [
    ("strike", r"(?i)\b(strike|walkout|industrial action)\b", 0.7),
    ("natural_disaster", r"(?i)\b(earthquake|flood|hurricane|wildfire)\b", 0.8),
    ("geopolitical", r"(?i)\b(war|sanctions|export ban)\b", 0.75),
    ("financial_distress", r"(?i)\b(bankruptcy|insolvency|default)\b", 0.8),
    ("regulatory", r"(?i)\b(recall|antitrust|regulator|investigation)\b", 0.5),
]
HEDGED = r"(?i)\b(no|not|avoids?|averts?|ends?|ended|resolved|may|might|could|risk of)\b"
#: Words that state a relation, and words that make a statement of it doubtful. Fixed values.
RELATION_CUE = r"(?i)\b(suppl\w*|sourc\w*|manufactur\w*|customer\w*|purchas\w*|sell\w*|provid\w*|buy)\b"
RELATION_NEGATED = r"(?i)\b(no longer|not|never|may|might|could|would|if|previously|potential)\b"
#: What a sentence says of an alias ({}), over its normalised text. Fixed values.
SUPPLIER_FORMS = [
    r"\b(?:we|our company)\b.{0,90}\b(?:source|purchase|buy)\w*.{0,60}\bfrom\s+{}",
    r"{}.{0,60}\b(?:supplies|provides)\b.{0,60}\b(?:us|our)\b",
    r"\bour suppliers?\b.{0,40}\b(?:include|is|are)\b.{0,40}{}",
]
CUSTOMER_FORMS = [r"\bwe\s+(?:supply|sell|provide)\b.{0,80}\bto\s+{}"]
#: What tells the kind of a relation, and the legal forms that end a company's name. Fixed values.
LOGISTICS_FORM, RAW_MATERIAL = r"\b(ship|transport|logistics)", "raw material"
LEGAL_SUFFIX = r"(?i)(?:[, ]+(?:incorporated|inc|corporation|corp|limited|ltd|plc|co)\.?)+$"
DROPPED_TAGS = ["script", "style", "noscript", "ix:header"]

S, D, I, B, TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


POSITIONS = schema(mmsi=T.LongType(), at=TS, lat=D, lon=D, sog=D)
SIGNALS = schema(id=S, company_id=S, location_id=S, source_type=S, severity=D, extracted=S, raw=S, observed_at=TS, ingested_at=TS)
COMPANIES = schema(id=S, name=S, ticker=S, cik=S, industry=S, country=S, is_synthetic=B, created_at=TS)
RELATIONSHIPS = schema(id=S, supplier_id=S, customer_id=S, source_signal_id=S, relationship_type=S, criticality=D, confidence=D, evidence=S, status=S, provenance=S, created_at=TS, reviewed_at=TS)
LABELS = schema(company_id=S, snapshot_id=S, target=S, label=S, as_of=TS, outcome_end=TS, available_at=TS, reviewed_by=S, source_url=S, rationale=S)
ARTICLES = T.StructType([T.StructField("articles", T.ArrayType(schema(title=S, url=S, seendate=S)))])
FILING_INDEX = schema(form=T.ArrayType(S), accessionNumber=T.ArrayType(S), primaryDocument=T.ArrayType(S), filingDate=T.ArrayType(S))
DIRECTORY = T.MapType(S, schema(cik_str=T.LongType(), ticker=S, title=S))
