"""Helpers that make parts of documents: quantities, codings, references, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpath.functions.units import SYSTEM

LOINC = "http://loinc.org"
#: Codes of common observations and documents, with their displays.
CONCEPTS = {
    "85353-1": "Vital signs, weight, height, head circumference, oxygen saturation and BMI panel",
    "29463-7": "Body weight", "8302-2": "Body height", "8310-5": "Body temperature", "8867-4": "Heart rate", "9279-1": "Respiratory rate",
    "85354-9": "Blood pressure panel with all children optional", "8480-6": "Systolic blood pressure", "8462-4": "Diastolic blood pressure",
    "2708-6": "Oxygen saturation in Arterial blood", "59408-5": "Oxygen saturation in Arterial blood by Pulse oximetry",
    "39156-5": "Body mass index (BMI) [Ratio]", "9843-4": "Head Occipital-frontal circumference", "2339-0": "Glucose [Mass/volume] in Blood",
    "1558-6": "Fasting glucose [Mass/volume] in Serum or Plasma", "4548-4": "Hemoglobin A1c/Hemoglobin.total in Blood", "718-7": "Hemoglobin [Mass/volume] in Blood",
    "4544-3": "Hematocrit [Volume Fraction] of Blood by Automated count", "2160-0": "Creatinine [Mass/volume] in Serum or Plasma",
    "33914-3": "Glomerular filtration rate/1.73 sq M.predicted [Volume Rate/Area] in Serum or Plasma by Creatinine-based formula (MDRD)",
    "2093-3": "Cholesterol [Mass/volume] in Serum or Plasma", "2085-9": "Cholesterol in HDL [Mass/volume] in Serum or Plasma",
    "2089-1": "Cholesterol in LDL [Mass/volume] in Serum or Plasma", "2571-8": "Triglyceride [Mass/volume] in Serum or Plasma",
    "10160-0": "History of Medication use Narrative", "48765-2": "Allergies and adverse reactions Document", "11450-4": "Problem list - Reported",
    "11369-6": "History of Immunization Narrative", "47519-4": "History of Procedures Document", "46264-8": "History of medical device use",
    "30954-2": "Relevant diagnostic tests/laboratory data Narrative", "8716-3": "Vital signs", "11348-0": "History of Past illness Narrative",
    "47420-5": "Functional status assessment note", "18776-5": "Plan of care note", "29762-2": "Social history Narrative",
    "10162-6": "History of pregnancies Narrative", "42348-3": "Advance directives",
    "60591-5": "Patient summary Document", "34133-9": "Summary of episode note", "18842-5": "Discharge summary", "11506-3": "Progress note",
    "34117-2": "History and physical note", "11488-4": "Consultation note",
}
#: Categories, by the last part of their system.
CATEGORIES = {
    "observation-category": ("vital-signs", "laboratory", "social-history", "imaging", "procedure", "survey", "exam", "therapy", "activity"),
    "condition-category": ("problem-list-item", "encounter-diagnosis"),
    "allergy-intolerance-category": ("food", "medication", "environment", "biologic"),
}
#: Names of units and their codes.
UNIT_CODES = {
    "kg": "kg", "lb": "[lb_av]", "g": "g", "cm": "cm", "m": "m", "in": "[in_i]", "ft": "[ft_i]", "celsius": "Cel", "fahrenheit": "[degF]", "mmHg": "mm[Hg]",
    "beats per minute": "/min", "breaths per minute": "/min", "percent": "%", "mg/dL": "mg/dL", "mmol/L": "mmol/L", "g/dL": "g/dL", "U/L": "U/L", "mEq/L": "meq/L",
    "mL/min/1.73 m2": "mL/min/{1.73_m2}", "kg/m2": "kg/m2", "seconds": "s", "minutes": "min", "hours": "h", "days": "d", "weeks": "wk", "months": "mo", "years": "a",
    "mL": "mL", "L": "L", "mg": "mg", "mcg": "ug", "mg/kg": "mg/kg", "units": "[iU]",
}


def quantity(value: Column, unit: str, code: str | None = None) -> Column:
    """unit: a name of UNIT_CODES, or the unit's code."""
    return F.struct(value.cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(SYSTEM).alias("system"), F.lit(code or UNIT_CODES.get(unit, unit)).alias("code"))


def coding(system: str, code: Column | str, display: str | None = None) -> Column:
    return F.struct(F.lit(system).alias("system"), (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(display).cast("string").alias("display"))


def concept(code: str) -> Column:
    """A CodeableConcept of a common observation or document."""
    return F.struct(F.array(coding(LOINC, code, CONCEPTS[code])).alias("coding"), F.lit(CONCEPTS[code]).alias("text"))


def category(code: str) -> Column:
    """A CodeableConcept of a category."""
    system = next(s for s, codes in CATEGORIES.items() if code in codes)
    display = code.replace("-", " ").title()
    base = "http://hl7.org/fhir/" if system.startswith("allergy") else "http://terminology.hl7.org/CodeSystem/"
    return F.struct(F.array(coding(base + system, code, display)).alias("coding"), F.lit(display).alias("text"))


def reference(type_name: str, key: Column) -> Column:
    return F.struct(F.concat(F.lit(f"{type_name}/"), key.cast("string")).alias("reference"))


def bundle(df: DataFrame, by: str, url: Column, kind: str = "collection") -> DataFrame:
    """The rows of df as entries of one bundle for each value of `by`."""
    entry = F.struct(url.alias("fullUrl"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("resource"))
    grouped = df.groupBy(by).agg(F.sort_array(F.collect_list(entry)).alias("entry"))
    return grouped.select(F.col(by).cast("string").alias("id"), F.lit("Bundle").alias("resourceType"), F.lit(kind).alias("type"), "entry")
