"""The marker registry: one line per marker, in panel order (the order is meaning: first alias wins)."""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexical import fold_abbreviation, fold_label
from .units import fold_unit

REGISTRY_VERSION = 2


class Marker(NamedTuple):
    """One marker: its key, its names as printed, its unit and what values are plausible."""

    key: str
    en: str
    el: str = ""
    abbreviations: list[str] = []
    aliases: list[str] = []
    unit: str | None = None
    plausible: tuple[float, float] | None = None
    #: The section that decides between this and another marker of an equally near name.
    section: str | None = None


#: The haematology panel and three chemistry markers. Other panels come from a file (``load``).
MARKERS = [
    Marker("rbc", "Red Blood Cells", el="Ερυθρά Αιμοσφαίρια", abbreviations=["RBC"], aliases=["RBC (RBC)", "Ερυθρά Αιμοσφαίρια (RBC) (RBC)", "Ερυθρά αιμοσφαίρια(RBC)"], unit="10^6/µL", plausible=(0.5, 12)),
    Marker("haemoglobin", "Haemoglobin", abbreviations=["HGB", "Hb"], aliases=["HGB (HGB)", "Αιμοσφαιρίνη (HGB) (HGB)", "Αιμοσφαιρίνη (HGB)"], unit="g/dL", plausible=(1, 30)),
    Marker("hct", "Haematocrit", el="Αιματοκρίτης", abbreviations=["HCT"], aliases=["HCT (HCT)", "Αιματοκρίτης (HCT) (HCT)", "Αιματοκρίτης (HCT)"], unit="%", plausible=(1, 80)),
    Marker("mcv", "Mean Corpuscular Volume", el="Μέσος Όγκος Ερυθρών", abbreviations=["MCV"], aliases=["MCV (MCV)", "Μέσος Όγκος Ερυθρών (MCV)", "Μέσος όγκος ερυθρών (MCV) (MCV)"], unit="fL", plausible=(30, 150)),
    Marker("mch", "Mean Corpuscular Haemoglobin", el="Μέση Περιεκτικότης HGB", abbreviations=["MCH"], aliases=["MCH (MCH)", "Μέση Περιεκτικότης HGB (MCH) (MCH)", "Μέση περιεκ. Αιμοσφαιρίνης (MCH)"], unit="pg", plausible=(5, 60)),
    Marker("mchc", "Mean Corpuscular Haemoglobin Concentration", el="Μέση Πυκνότης HGB", abbreviations=["MCHC"], aliases=["MCHC (MCHC)", "Μέση Πυκνότης HGB (MCHC) (MCHC)", "Μέση πυκν. Αιμοσφαιρίνης (MCHC)"], unit="g/dL", plausible=(10, 50)),
    Marker("rdw", "Red Cell Distribution Width", el="Εύρος Κατανομής Ερυθρών", abbreviations=["RDW"], aliases=["Εύρος Κατανομής Ερυθρών (RDW) (RDW)"], unit="%", plausible=(5, 40)),
    Marker("rdw-sd", "Red Cell Distribution Width (Standard Deviation)", el="Εύρος Κατανομής Ερυθρών (SD)", abbreviations=["RDWSD"], aliases=["RDWSD (RDWSD)"], unit="fL", plausible=(10, 150)),
    Marker("wbc", "White Blood Cells", el="Λευκά Αιμοσφαίρια", abbreviations=["WBC"], aliases=["WBC (WBC)", "Λευκά Αιμοσφαίρια (WBC) (WBC)", "Λευκά αιμοσφαίρια (WBC)"], unit="10^3/µL", plausible=(0.1, 500)),
    Marker("neutrophils-percent", "Neutrophils %", el="Πολυμορφοπύρηνα Ουδετερόφιλα %", abbreviations=["NEUT%", "NEU%"], aliases=["NEUT% (NEUT%)", "Πολυμ. Ουδετερόφιλα(NEU%)"], unit="%", plausible=(0, 100)),
    Marker("neutrophils-absolute", "Neutrophils, absolute count", el="Πολυμορφοπύρηνα Ουδετερόφιλα #", abbreviations=["NEUT#", "NEU#"], aliases=["NEUT# (NEUT#)", "Πολυμ. Ουδετερόφιλα(NEU#)"], unit="10^3/µL", plausible=(0, 500)),
    Marker("lymphocytes-percent", "Lymphocytes %", el="Λεμφοκύτταρα %", abbreviations=["LYMP%", "LYM%"], aliases=["LYMP% (LYMP%)", "Λεμφοκύτταρα (LYM%)"], unit="%", plausible=(0, 100)),
    Marker("lymphocytes-absolute", "Lymphocytes, absolute count", el="Λεμφοκύτταρα #", abbreviations=["LYMP#", "LYM#"], aliases=["LYMP# (LYMP#)", "Λεμφοκύτταρα (LYM#)"], unit="10^3/µL", plausible=(0, 500)),
    Marker("monocytes-percent", "Monocytes %", el="Μονοπύρηνα %", abbreviations=["MONO%", "MON%"], aliases=["MONO% (MONO%)", "Μονοπύρηνα (MONO) % (MONO%)"], unit="%", plausible=(0, 100)),
    Marker("monocytes-absolute", "Monocytes, absolute count", el="Μονοπύρηνα #", abbreviations=["MONO#"], aliases=["MONO# (MONO#)", "Μονοπύρηνα (MONO#)", "Μονοκύτταρα (MONO#)"], unit="10^3/µL", plausible=(0, 500)),
    Marker("eosinophils-percent", "Eosinophils %", el="Πολυμορφοπύρηνα Ηωσινόφιλα %", abbreviations=["EOSI%", "EOS%"], aliases=["EOSI% (EOSI%)", "Πολυμ. Ηωσινόφιλα (EOS%)"], unit="%", plausible=(0, 100)),
    Marker("eosinophils-absolute", "Eosinophils, absolute count", el="Πολυμορφοπύρηνα Ηωσινόφιλα #", abbreviations=["EOSI#", "EOS#"], aliases=["EOSI# (EOSI#)", "Πολυμ. Ηωσινόφιλα (EOS#)"], unit="10^3/µL", plausible=(0, 500)),
    Marker("basophils-percent", "Basophils %", el="Πολυμορφοπύρηνα Βασεόφιλα %", abbreviations=["BASO%", "BAS%"], aliases=["BASO% (BASO%)", "Πολυμ. Βασεόφιλα (BASO%)"], unit="%", plausible=(0, 100)),
    Marker("basophils-absolute", "Basophils, absolute count", el="Πολυμορφοπύρηνα Βασεόφιλα #", abbreviations=["BASO#"], aliases=["BASO# (BASO#)", "Πολυμ. Βασεόφιλα (BASO#)"], unit="10^3/µL", plausible=(0, 500)),
    Marker("plt", "Platelets", el="Αιμοπετάλια", abbreviations=["PLT"], aliases=["PLT (PLT)", "Αιμοπετάλια (PLT) (PLT)", "Αιμοπετάλια (PLT)"], unit="10^3/µL", plausible=(1, 5000)),
    Marker("mpv", "Mean Platelet Volume", el="Μέσος Όγκος Αιμοπεταλίων", abbreviations=["MPV"], aliases=["MPV (MPV)", "Μέσος όγκος αιμ. (MPV)"], unit="fL", plausible=(2, 30)),
    Marker("pct", "Plateletcrit", el="Αιμοπεταλιοκρίτης", abbreviations=["PCT"], aliases=["Αιμοπεταλιοκρίτης (PCT) (PCT)", "Αιμοπεταλιοκρίτης (PCT)"], unit="%", plausible=(0.01, 5)),
    Marker("pdw", "Platelet Distribution Width", el="Εύρος Κατανομής Αιμοπεταλίων", abbreviations=["PDW", "PWD"], aliases=["Εύρος Κατανομής Αιμοπεταλίων (PDW) (PDW)", "Εύρος καταν. αιμ. (PDW)"], unit="%", plausible=(1, 100)),
    Marker("nrbc-percent", "Nucleated Red Blood Cells %", el="Εμπύρηνα Ερυθρά %", abbreviations=["NRBC%"], aliases=["Εμπύρηνα Ερυθρά (NRBC%)", "Εμπύρηνα RBC"], unit="%", plausible=(0, 100)),
    Marker("glucose", "Glucose", el="Γλυκόζη", abbreviations=["GLU"], aliases=["Σάκχαρο"], unit="mg/dL", plausible=(10, 2000)),
    Marker("creatinine", "Creatinine", el="Κρεατινίνη", abbreviations=["CREA"], unit="mg/dL", plausible=(0.1, 25)),
    Marker("cholesterol", "Cholesterol", el="Χοληστερόλη", abbreviations=["CHOL"], unit="mg/dL", plausible=(10, 1000)),
]


def _constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that is part of the plan: one literal, no Python on the executors."""
    names_ = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(names_, r, strict=True)) for r in rows], ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def load(path: str) -> list[Marker]:
    """Markers from a JSON file on the driver: a list of objects with ``Marker``'s fields, checked by ``faults``."""
    with open(path, encoding="utf-8") as f:
        found = [Marker(**{k: tuple(v) if k == "plausible" and v else v for k, v in m.items()}) for m in json.load(f)]
    if wrong := faults(found):
        raise ValueError("; ".join(wrong))
    return found


def markers(spark: SparkSession, registry: list[Marker] | None = None) -> DataFrame:
    """(ord, marker_key, en, unit, low, high): a fixed dimension, small enough to broadcast anywhere."""
    rows = [(i, m.key, m.en, m.unit, *(map(float, m.plausible) if m.plausible else (None, None))) for i, m in enumerate(MARKERS if registry is None else registry)]
    return _constant(spark, rows, "ord int, marker_key string, en string, unit string, low double, high double")


def names(spark: SparkSession, registry: list[Marker] | None = None) -> DataFrame:
    """(ord, marker_key, kind, name, section, norm): every abbreviation and printed name in its matching form."""
    rows = []
    for i, m in enumerate(MARKERS if registry is None else registry):
        rows += [(i, m.key, "abbreviation", a, m.section, fold_abbreviation(a)) for a in m.abbreviations]
        rows += [(i, m.key, "alias", a, m.section, fold_label(a)) for a in [m.en, m.el, *m.aliases] if a]
    return _constant(spark, rows, "ord int, marker_key string, kind string, name string, section string, norm string")


def faults(registry: list[Marker]) -> list[str]:
    """What is wrong with a registry: keys, names, ranges and printed forms that two markers share. A driver-side check of a small constant."""
    out, keys, forms = [], set(), {}
    for m in registry:
        if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", m.key):
            out.append(f"{m.key}: malformed key")
        if m.key in keys:
            out.append(f"{m.key}: repeated key")
        keys.add(m.key)
        printed = [n for n in [m.en, m.el, *m.aliases, *m.abbreviations] if n]
        if any(n != n.strip() for n in printed) or not m.en:
            out.append(f"{m.key}: untrimmed or missing name")
        if m.unit is not None and fold_unit(m.unit) != m.unit:
            out.append(f"{m.key}: unit is not in its canonical spelling")
        if m.plausible is not None and not m.plausible[0] < m.plausible[1]:
            out.append(f"{m.key}: plausible range")
        for n in printed:
            form = fold_label(n)
            if forms.setdefault(form, m.key) != m.key:
                out.append(f"{m.key}: {n!r} is also printed for {forms[form]}")
    return out
