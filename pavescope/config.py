"""Parameters of the road-condition operators."""

from __future__ import annotations

CLASSES = ("D00", "D10", "D20", "D40")
# Density factor of a box by class, deduct curves a + b * log10(density) up to a most, severity weights.
DENSITY = {"D00": 10.5, "D10": 4.2, "D20": 41.0, "D40": 0.7}
DEDUCT = {"D00": (8.0, 15.0, 60.0), "D10": (8.0, 15.0, 60.0), "D20": (22.0, 23.0, 85.0), "D40": (55.0, 30.0, 95.0)}
KAPPA_LOW, KAPPA_MID, KAPPA_HIGH = 0.33, 1.0, 3.0
HORIZON, CDV_REST, RIDE_RATE, RIDE_FROM, VISUAL = 0.40, 0.35, 0.18, 1.0, 0.65
STATES = (("bueno", 86), ("satisfactorio", 71), ("regular", 56), ("malo", 41), ("muy_malo", 0))
# Field filters.
TAU_FIELD = {"D00": 0.25, "D10": 0.15, "D20": 0.20, "D40": 0.20}
SURFACES = {"asfalto": CLASSES, "adoquin": ("D40",)}
NEIGHBOURS, PERSIST_IOU, SHIFT = 2, 0.30, 0.15
EARTH_M = 6_371_000.0
# Class weights of the first rule score.
RULE_WEIGHTS = {"D00": 4.0, "D10": 4.0, "D20": 8.0, "D40": 12.0}
#: Confidence from which a box counts as a detection for severity cutoffs and scores, from which it has a say at all, and of the rule score.
DETECTION, SOFT, RULE_CONF = 0.5, 0.05, 0.98
# Actions that a state allows, urgency of a priority level, days to act.
ACTIONS = ("mantenimiento_rutinario", "sellado_de_fisuras", "parcheo", "bacheo", "rehabilitacion", "reconstruccion")
ALLOWED = {
    "bueno": ("mantenimiento_rutinario",), "satisfactorio": ("mantenimiento_rutinario", "sellado_de_fisuras"), "regular": ("sellado_de_fisuras", "parcheo", "bacheo"),
    "malo": ("parcheo", "bacheo", "rehabilitacion"), "muy_malo": ("bacheo", "rehabilitacion", "reconstruccion"),
}
URGENCY = {"alta": "inmediata_30_dias", "media": "programada_6_meses", "baja": "rutinaria_12_meses"}
# Codes of the city's road inventory (surface, state), and surface groups.
CITY_SURFACE = {0: "sin dato", 1: "rigido", 2: "flexible", 3: "mixto", 4: "adoquin_concreto", 5: "adoquin_arcilla", 6: "afirmado", 8: "tierra", 12: "piedra_laja", 13: "placa_huella"}
CITY_STATE = {1: "bueno", 2: "regular", 3: "malo"}
CITY_GROUP = {"flexible": "asfalto", "adoquin_concreto": "adoquin", "adoquin_arcilla": "adoquin"}
# Names of damages in texts, and of states.
DAMAGE_TEXT = {"D00": "grieta longitudinal", "D10": "grieta transversal", "D20": "piel de cocodrilo", "D40": "bache"}
# Weights of crashes by gravity, and the area that they are looked for in (latitudes, longitudes).
CRASH_WEIGHT = {"SOLO DANOS": 1, "CON HERIDOS": 3, "CON MUERTOS": 10}
CRASH_AREA = ((3.5, 5.0), (-75.0, -73.5))
CENTRE = (4.598, -74.076)
# Radii in metres around a point by what is counted, and years of crashes that count.
RADII, CRASH_YEARS = {"colegio": (300, 500), "ips": (500, 1000), "hospital": (1000,), "siniestros": (100, 250)}, 3
# Columns of the city's table of road priorities, as its file names them and as they are named here.
ROAD_SCORES = {
    "PUNTAJE_DP": "p_poblacion", "PUNTAJE__1": "p_densidad", "PUNTAJE_PE": "p_peticiones", "PUNTAJE_SI": "p_sitios_sociales", "PUNTAJE_US": "p_uso_social",
    "PUNTAJE_DI": "dim_social", "PUNTAJE__2": "p_uso_economico", "PUNTAJE__3": "p_sitios_economicos", "PUNTAJE__4": "dim_economica", "PUNTAJE_MA": "p_malla",
    "PUNTAJE_RU": "p_rutas_transporte", "PUNTAJE__5": "p_siniestros", "PUNTAJE__6": "dim_tecnica", "PUNTAJE_IP": "ip_umv", "IP_RELATIV": "ip_relativo_umv", "PUNTAJE__7": "ip_max_umv",
}
ROAD_SIZES = {"ANCHOCALZA": "ancho_m", "AREACALZAD": "area_m2", "LONGITUDHO": "longitud_umv_m", "TIPOSUPERF": "tipo_superficie"}
ROAD_IDS, ROAD_RANGE, ROAD_SHAPE = {"CIV": "civ", "PK_ID_CALZ": "pk_calzada"}, {"RANGOS_IP": "rango_ip_umv"}, "the_geom"
SOCIAL_PARTS, INDEX_PARTS, SUM_SLACK = ("p_poblacion", "p_densidad", "p_peticiones", "p_sitios_sociales", "p_uso_social"), ("dim_social", "dim_economica", "dim_tecnica"), 0.05
CRASH_COLUMNS = {"LATITUD": "lat", "LONGITUD": "lon", "GRAVEDAD": "gravedad", "ANO_OCURRENCIA_ACC": "anio", "CIV": "civ"}
HOSPITAL_WORDS = ("HOSPITAL", "CLINICA", "CLÍNICA")
