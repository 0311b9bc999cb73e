"""The patient context against a plain loop over documents."""

import hashlib
import re

from notewarden.operators import context as X

GROUPS = {"NEURO_EXAM": ["gcs", "lemah"], "LAB": ["hemoglobin", "hb"], "DIAGNOSIS_STROKE": ["stroke"]}
ALLOWED = {"lab": ["LAB"], "cppt_ranap": ["NEURO_EXAM", "LAB"]}
RULES = X.ContextRules(GROUPS, quotas={"NEURO_EXAM": 2, "LAB": 3, "DIAGNOSIS_STROKE": 1}, allowed=ALLOWED, budget=900, snippet_chars=60)
ROWS = [
    ("p1", "b_lab.txt", "lab", "Hemoglobin 12\n\nstroke GCS 15.\nHB 13!\nHB 13!\nHB 13!\n" + "lain\n" * 9 + "hb akhir"),
    ("p1", "a_resume.txt", "resume", "stroke akut. GCS 14; lemah kiri.\nGCS 13.\nkosong\nkosong\nkosong\nkosong\nGCS 12.\nstroke lama."),
    ("p1", "A_Resume2.txt", "resume", "stroke akut. GCS 14; lemah kiri.\nGCS 13.\nhbx hemoglobin"),
    ("p1", "ranap.txt", "cppt_ranap", "\n".join(f"lemah hari {i}." for i in range(9))),
    ("p1", "kosong.txt", "other", ""),
    ("p1", "nihil.txt", "other", None),
    ("p2", "lab.txt", "lab", "tidak ada apa-apa"),
    (None, "surat.txt", None, "GCS 15 " + "panjang " * 40 + "stroke"),
    *[("p3", f"surat_{i:03d}.txt", "other", f"stroke ke {i % 7}.") for i in range(120)],
]


def plain(rows, rules):
    """The same rules, one document after another."""
    out = {}
    for patient in {r[0] for r in rows}:
        docs = sorted((r for r in rows if r[0] == patient), key=lambda r: (rules.type_order.get(r[2], 9), r[1].lower(), r[1]))
        seen, kept = set(), {}
        for _, file, kind, text in docs:
            lines = [x for x in (re.sub(r"\s+", " ", y).strip() for y in (text or "").split("\n")) if x]
            blocks, held = [], []
            for line in lines:
                held.append(line)
                if len(held) == 4 or line[-1] in ".!?;:":
                    blocks.append(" ".join(held))
                    held = []
            blocks += [" ".join(held)] if held else []
            for group, words in rules.groups.items():
                if kind in rules.allowed and group not in rules.allowed[kind]:
                    continue
                quota = min(rules.quota(group), rules.type_quotas.get(kind, 99))
                own = []
                for i, block in enumerate(blocks):
                    low = block.lower()
                    hits = sorted(w for w in words if (re.search(rf"\b{w}\b", low) if len(w) <= 3 else w in low))
                    if not hits or len(own) == quota:
                        continue
                    snippet = " ".join(blocks[max(0, i - 1):i + 2])
                    snippet = snippet[:rules.snippet_chars] + " ...[truncated]" if len(snippet) > rules.snippet_chars else snippet
                    digest = hashlib.md5(snippet.lower().encode()).hexdigest()
                    if digest not in [o[0] for o in own]:
                        own.append((digest, hits, snippet))
                for digest, hits, snippet in own:
                    if digest not in seen:
                        seen.add(digest)
                        kept.setdefault(group, []).append((file, kind or "", hits, snippet))
        parts = [f"PATIENT_ID: {patient or ''}", "", X.DOCUMENTS_TITLE, *[f"- {d[1]} | doc_type: {d[2] or ''}" for d in docs], "", *X.INSTRUCTIONS]
        shown = 0
        for group in rules.order:
            parts += ["", f"===== {group} ====="]
            entries = kept.get(group, [])[:rules.quota(group)]
            shown += len(entries)
            parts += [] if entries else [X.NOTHING_FOUND]
            for n, (file, kind, hits, snippet) in enumerate(entries, 1):
                parts += ["", f"[{n}] source: {file} | doc_type: {kind} | matched: {', '.join(hits)}", snippet]
        whole = "\n".join(parts)
        context = whole[:rules.budget] + X.CUT_NOTE.format(budget=rules.budget) if len(whole) > rules.budget else whole
        out[patient] = (context, len(context), len(docs), shown)
    return out


SCHEMA = "patient_id string, source_file string, doc_type string, text string, patient string, place string"


def test_context_against_a_plain_loop(spark):
    d = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA)
    for rules in (RULES, X.ContextRules(GROUPS, allowed=ALLOWED, budget=100_000)):
        got = {r["patient_id"]: tuple(r)[1:] for r in X.context_texts(d, rules).collect()}
        assert got == plain(ROWS, rules)


def test_context_of_an_empty_table(spark):
    assert X.context_texts(spark.createDataFrame([], SCHEMA), RULES).collect() == []


def test_joins_are_equi_joins(spark, capsys):
    X.context_texts(spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA), RULES).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
