"""Initial readings with their evidence, and flags with recorded labels.

A reading is one match of a pattern whose groups fill named slots, in whatever
order the pattern captures them.  The match, its slots, its file and the text
around it travel as one value, so a patient's winner - the smallest (document
priority, place, file) - brings its own evidence along without a second join."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions import text as T
from .clinical import FILE, NOT_RECORDED, TEXT, Extractor, Found, _first_of, _flag, _priority

# ---------------------------------------------------------------------------
# Priorities, patterns, labels.
# ---------------------------------------------------------------------------
INITIAL_PRIORITY = {"cppt_igd": 1, "resume": 2, "cppt_ranap": 3, "other": 4}
COMA_TOTAL = r"(?i)\b(?:GCS|Glasgow\s*Coma\s*Scale)\s*[:=]?\s*(1[0-5]|[3-9])\b"
COMA_PARTS = r"(?i)\b(?:GCS\s*[:=]?\s*)?E\s*(\d)\s*(?:M\s*(\d)\s*V\s*(\d)|V\s*(\d)\s*M\s*(\d))\b"
CONSCIOUSNESS = [
    r"(?i)\bcompos\s*mentis\b", r"(?i)\bCM\b", r"(?i)\bsomnolen\b", r"(?i)\bsopor\b", r"(?i)\bkoma\b", r"(?i)\bapatis\b", r"(?i)\bdelirium\b",
]
# systolic 50 to 300, diastolic 30 to 200
PRESSURE = r"(?i)\b(?:TD|Tensi|Tekanan\s*Darah|BP)\s*[:=]?\s*(0?[5-9]\d|[12]\d\d|300)\s*/\s*(0?[3-9]\d|1\d\d|200)\b"
STROKE_SCALE = r"(?i)\b(?:NIHSS|NIH\s*Stroke\s*Scale)\s*[:=]?\s*(4[0-2]|[0-3]?\d)\b"
EVIDENCE_RADIUS, EVIDENCE_CHARS = 100, 450

DRUG_CLASSES = {
    "antiplatelet_aspirin": r"\b(?:aspirin|asetosal|ascardia)\b",
    "antiplatelet_clopidogrel": r"\b(?:clopidogrel|clopid)\b",
    "antiplatelet_cilostazol": r"\bcilostazol\b",
    "antiplatelet_ticagrelor": r"\bticagrelor\b",
    "antikoagulan": r"\b(?:warfarin|heparin|enoxaparin|rivaroxaban|apixaban|dabigatran)\b",
    "statin": r"\b(?:statin|atorvastatin|simvastatin|rosuvastatin)\b",
    "antihipertensi": r"\b(?:amlodipin|nicardipin|(?:captopril|labetalol|valsartan|candesartan|bisoprolol)\b)",
    "mannitol": r"\b(?:manitol|mannitol)\b",
    "citicoline": r"\b(?:citicoline|sitikolin|citicholine)\b",
    "ppi": r"\b(?:omeprazole|pantoprazole|rabeprazole|lansoprazole|sucralfat)\b",
    "antibiotik": r"\b(?:ceftriaxone|levofloxacin|moxifloxacin|azithromycin|cefixime|cefotaxime|metronidazole)\b",
    "antiepilepsi": r"\b(?:levetiracetam|phenytoin|fenitoin|valproat)\b",
    "insulin": r"\b(?:insulin|novorapid|lantus)\b",
}
RECORDED_RISKS = {
    "hipertensi": r"\b(?:hipertensi|hypertension|HT|HD|darah\s*tinggi)\b",
    "diabetes_melitus": r"\b(?:diabetes?|DM|diabetes\s*melitus|kencing\s*manis|gula\s*darah|hiperglikemi)\b",
    "dislipidemia": r"\b(?:dislipidemia|dyslipidemia|kolesterol|hiperlipidemia|hiperkolesterolemia)\b",
    "atrial_fibrilasi": r"\b(?:atrial\s*fibrilasi|atrial\s*fibrillation|AF|AFib|CAF|flutter)\b",
    "penyakit_jantung": r"\b(?:jantung|cardio|CAD|PJK|kardiomegali|CHF|gagal\s*jantung|heart\s*failure|IHD)\b",
    "stroke_sebelumnya": r"\b(?:stroke\s*ulang|riwayat\s*stroke|stroke\s*sebelumnya|previous\s*stroke|stroke\s*ec\s+infark)\b",
    "merokok": r"\b(?:merokok|smoking|perokok|rokok|smoker)\b",
    "obesitas": r"\b(?:obesitas|obesity|obes|IMT\s*>=?3[05]|BMI\s*>=?3[05])\b",
}
RECORDED_ACTIONS = {
    "konsul_neurologi": r"\b(?:konsul\s*neuro|(?:sp\s*[ns]|dokter\s*saraf)\b)",
    "konsul_bedah_saraf": r"\b(?:bedah\s*saraf|sp\s*bs)\b",
    "konsul_jantung": r"\b(?:konsul\s*jantung|(?:sp\s*jp|ekg)\b)",
    "rawat_icu_hcu": r"\b(?:ICU|HCU|intensive\s*care|NICU|PICU)\b",
    "fisioterapi": r"\b(?:fisioterapi|rehab|mobilisasi)\b",
    "konsul_gizi": r"\b(?:konsul\s*gizi|(?:ahli\s*)?gizi\b)",
    "skrining_menelan": r"\b(?:skrining\s*menelan|swallowing|disfagia|tes\s*menelan)\b",
    "edukasi_keluarga": r"\b(?:edukasi|informed\s*consent|penjelasan\s*keluarga)\b",
}
EARLIER_ILLNESS = r"(?id)(?:RPD|Riwayat\s*Penyakit\s*(?:Terdahulu|Dahulu|Sebelumnya))\s*[:=]?\s*(.{20,300})"
EARLIER_ILLNESS_CHARS = 300
RECORDED, DONE = "ada", "dilakukan"


# ---------------------------------------------------------------------------
# Readings
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Reading:
    """A pattern and its slots: for each the groups that may hold it."""

    pattern: str
    slots: dict[str, tuple[int, ...]]

    def found(self, name: str, priority: dict[str, int]) -> Found:
        """The first match of a document, as JSON with ``hit``, ``file``,
        ``evidence`` and one number per slot.  Its place comes from the piece
        before it, so it counts characters also where a text holds wide ones."""
        t = F.col(TEXT)
        hit = F.nullif(F.regexp_extract(t, self.pattern, 0), F.lit(""))
        at = F.length(F.get(F.split(t, self.pattern, 2), F.lit(0)))

        def filled(h: Column) -> list[Column]:
            return [F.coalesce(*[F.regexp_extract(h, self.pattern, i).try_cast("int") for i in groups]).alias(slot) for slot, groups in self.slots.items()]

        around = T.char_context(t, at, at + F.length(hit), EVIDENCE_RADIUS, EVIDENCE_CHARS)
        value = F.to_json(F.struct(hit.alias("hit"), F.col(FILE).alias("file"), around.alias("evidence"), *filled(hit)))
        return Found(name, F.when(hit.isNotNull(), value), _priority(priority), F.when(hit.isNotNull(), at))


def _part(value: Column, name: str) -> Column:
    return F.get_json_object(value, f"$.{name}")


def _reader(name: str, readings: list[Reading], fields: Callable[[Column], dict[str, Column]], extra: Callable[[], list[Found]] = list, **unknown: str) -> Extractor:
    """Readings of one kind, in files of every type that :data:`INITIAL_PRIORITY` lists."""
    own = f"__{name}"
    return Extractor(
        lambda: [*[r.found(own, INITIAL_PRIORITY) for r in readings], *extra()],
        tuple(INITIAL_PRIORITY),
        defaults=unknown,
        derive={own: fields},
    )


def _coma(value: Column) -> dict[str, Column]:
    parts = [_part(value, s).cast("int") for s in ("e", "m", "v")]
    total = F.coalesce(_part(value, "total").cast("int"), reduce(lambda a, b: a + b, parts))
    return {
        "gcs_initial_total": total, "gcs_initial_text": _part(value, "hit"), "gcs_source": _part(value, "file"), "gcs_evidence": _part(value, "evidence"),
        "gcs_eye": parts[0], "gcs_motor": parts[1], "gcs_verbal": parts[2],
    }


def _pressure(value: Column) -> dict[str, Column]:
    high, low = _part(value, "systolic"), _part(value, "diastolic")
    return {
        "blood_pressure_initial": F.concat(high, F.lit("/"), low), "systolic_bp_initial": high, "diastolic_bp_initial": low,
        "bp_source": _part(value, "file"), "bp_evidence": _part(value, "evidence"),
    }


def _scale(value: Column) -> dict[str, Column]:
    return {
        "nihss_score": _part(value, "score"), "nihss_documented": F.when(value.isNotNull(), "yes"),
        "nihss_source": _part(value, "file"), "nihss_evidence": _part(value, "evidence"),
    }


def _consciousness() -> list[Found]:
    """First file with any of the words; within it the first word of the list."""
    return [Found("consciousness_text", _first_of(F.col(TEXT), CONSCIOUSNESS, 0))]


initial_gcs = _reader(
    "gcs", [Reading(COMA_TOTAL, {"total": (1,)}), Reading(COMA_PARTS, {"e": (1,), "m": (2, 5), "v": (3, 4)})], _coma, _consciousness,
    gcs_initial_total="unknown", gcs_initial_text="unknown", consciousness_text="unknown",
)
initial_pressure = _reader(
    "bp", [Reading(PRESSURE, {"systolic": (1,), "diastolic": (2,)})], _pressure,
    blood_pressure_initial="unknown", systolic_bp_initial="unknown", diastolic_bp_initial="unknown",
)
initial_nihss = _reader("nihss", [Reading(STROKE_SCALE, {"score": (1,)})], _scale, nihss_score="unknown", nihss_documented="no")


# ---------------------------------------------------------------------------
# Flags with recorded labels
# ---------------------------------------------------------------------------
def recorded_flags(patterns: dict[str, str], value: str, absent: str = NOT_RECORDED, any_case: bool = False) -> Extractor:
    """One flag per pattern, over the documents of every type.  Texts are
    lower-cased first, as these flags are defined, so upper-case abbreviations of a
    pattern find nothing unless ``any_case`` is set."""
    return Extractor(
        lambda: [_flag(F.lower(TEXT).rlike(("(?i)" if any_case else "") + p), name, value) for name, p in patterns.items()],
        defaults={name: absent for name in patterns},
    )


drug_classes = recorded_flags(DRUG_CLASSES, "diberikan")
recorded_risks = recorded_flags(RECORDED_RISKS, RECORDED)
recorded_actions = recorded_flags(RECORDED_ACTIONS, DONE)
earlier_illness = Extractor(
    lambda: [Found("rpd_text", T.clean_snippet(F.nullif(F.regexp_extract(F.col(TEXT), EARLIER_ILLNESS, 1), F.lit("")), EARLIER_ILLNESS_CHARS))],
    ("resume", "cppt_igd"), defaults={"rpd_text": "unknown"},
)
