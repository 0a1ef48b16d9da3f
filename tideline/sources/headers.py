"""Resolution of localised headers and file names to the canonical schema."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

# The canonical fields, in the order in which they claim headers.
FIELD_ORDER = (
    "cycleStart", "cycleEnd", "recovery", "rhr", "hrv", "skinTemp", "spo2", "strain", "calories", "maxHr", "avgHr", "sleepOnset", "wakeOnset", "sleepPerformance",
    "respiratoryRate", "asleep", "inBed", "light", "deep", "rem", "awake", "sleepNeed", "sleepDebt", "sleepEfficiency", "sleepConsistency", "nap", "workoutStart",
    "workoutEnd", "duration", "activity", "activityStrain", "zone1", "zone2", "zone3", "zone4", "zone5", "distance", "altitudeGain", "question", "answeredYes", "notes",
)

# The kinds of file, in the order in which they are tried, and a field that tells each.
KINDS = {"journal": "question", "workouts": "activity", "cycles": "recovery", "sleeps": "sleepPerformance"}

# Parts of file names by language and kind.
FILE_NAMES = {
    "en": {"journal": ["journal"], "workouts": ["workout"], "cycles": ["physiological", "cycle"], "sleeps": ["sleep"]},
    "es": {"journal": ["diario"], "workouts": ["entrenamiento"], "cycles": ["ciclo"], "sleeps": ["sueno"]},
}

# Parts of headers by language and field; a tuple asks for all its parts.
HEADERS = {
    "en": {
        "cycleStart": ["cyclestart"], "cycleEnd": ["cycleend"], "recovery": ["recoveryscore"], "rhr": ["restingheartrate"], "hrv": ["heartratevariability"],
        "skinTemp": ["skintemp"], "spo2": ["bloodoxygen", "spo2"], "strain": ["daystrain"], "calories": ["energyburned"], "maxHr": ["maxhr"], "avgHr": ["averagehr"],
        "sleepOnset": ["sleeponset"], "wakeOnset": ["wakeonset"], "sleepPerformance": ["sleepperformance"], "respiratoryRate": ["respiratoryrate"],
        "asleep": ["asleepduration"], "inBed": ["inbedduration"], "light": ["lightsleepduration"], "deep": [("deep", "duration")], "rem": ["remduration"],
        "awake": ["awakeduration"], "sleepNeed": ["sleepneed"], "sleepDebt": ["sleepdebt"], "sleepEfficiency": ["sleepefficiency"],
        "sleepConsistency": ["sleepconsistency"], "nap": ["nap"], "workoutStart": ["workoutstart"], "workoutEnd": ["workoutend"], "duration": [("duration", "min")],
        "activity": ["activityname"], "activityStrain": ["activitystrain"], "zone1": ["hrzone1"], "zone2": ["hrzone2"], "zone3": ["hrzone3"], "zone4": ["hrzone4"],
        "zone5": ["hrzone5"], "distance": ["distance"], "altitudeGain": ["altitudegain"], "question": ["questiontext"], "answeredYes": ["answeredyes"], "notes": ["notes"],
    },
    "es": {
        "cycleStart": ["horadeiniciodelciclo"], "cycleEnd": ["horadefinalizaciondelciclo"], "recovery": ["puntuacionderecuperacion"], "rhr": ["frecuenciacardiacaenreposo"],
        "hrv": ["variabilidaddelafrecuenciacardiaca"], "skinTemp": ["tempcutanea"], "spo2": ["oxigenoensangre"], "strain": ["esfuerzodeldia"], "calories": ["energiaquemada"],
        "maxHr": ["fcmax"], "avgHr": ["fcpromedio"], "sleepOnset": ["iniciodelsueno"], "wakeOnset": ["iniciodelavigilia"], "sleepPerformance": ["calificaciondelsueno"],
        "respiratoryRate": ["frecuenciarespiratoria"], "asleep": ["duraciondelsueno"], "inBed": ["tiempoenlacama"], "light": ["duraciondesuenoligero"],
        "deep": ["duraciondesuenoprofundo"], "rem": ["duraciondesuenorem"], "awake": ["tempodespierto"], "sleepNeed": ["suenonecesario"], "sleepDebt": ["deudadesueno"],
        "sleepEfficiency": ["eficienciadelsueno"], "sleepConsistency": ["regularidaddelsueno"], "nap": ["siesta"], "workoutStart": ["horadeiniciodelentrenamiento"],
        "workoutEnd": ["horadefinalizaciondelentrenamiento"], "duration": [("duracion", "min")], "activity": ["nombredelaactividad"], "activityStrain": ["esfuerzodeactividad"],
        "zone1": ["zonafc1"], "zone2": ["zonafc2"], "zone3": ["zonafc3"], "zone4": ["zonafc4"], "zone5": ["zonafc5"], "distance": ["distancia"],
        "altitudeGain": ["gananciadealtitud"], "question": ["textodelapregunta"], "answeredYes": ["respondiosi"], "notes": ["notas"],
    },
}

# Headers that are known and not read.
IGNORED = {"en": ["cycletimezone", "gpsenabled"], "es": ["zonahorariadelciclo", "gpshabilitado"]}


def normalize_header(header: str) -> str:
    folded = unicodedata.normalize("NFD", header)
    return "".join(c for c in folded.lower() if "a" <= c <= "z" or "0" <= c <= "9")


def _accepts(fragments: Iterable, text: str) -> bool:
    return any(all(part in text for part in ((f,) if isinstance(f, str) else f)) for f in fragments)


def claims(field: str, header: str) -> bool:
    return any(_accepts(pack[field], header) for pack in HEADERS.values())


def map_headers(headers: Sequence[str]) -> dict[str, str]:
    """Canonical field to header: from left to right, each header fills the first open field that claims it."""
    found: dict[str, str] = {}
    for header in headers:
        name = normalize_header(header)
        field = next((f for f in FIELD_ORDER if f not in found and claims(f, name)), None)
        if field:
            found[field] = header
    return found


def detect_kind(file_name: str, headers: Sequence[str]) -> str | None:
    """By the name of the file or by a telling field, in the order of ``KINDS``."""
    base, mapped = normalize_header(file_name.rsplit("/", 1)[-1]), map_headers(headers)
    for kind, signature in KINDS.items():
        if any(_accepts(names[kind], base) for names in FILE_NAMES.values()) or signature in mapped:
            return kind
    return None


def is_junk(path: str) -> bool:
    return "__MACOSX" in path or path.rsplit("/", 1)[-1].startswith("._")
