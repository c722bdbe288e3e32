"""Word lists, patterns and limits that decide the results.

Patterns are written for the JVM. ``(?U)`` makes word, digit and blank classes
Unicode-aware and ``(?d)`` makes a line feed the only line end.
"""

# --- Fixed values: cleaning patterns ---------------------------------------
URL = r"https?://(?U)\S+"
HASHTAG = r"#([\p{L}0-9_]+)"
LEADING_MENTIONS = r"(?U)^(?:@[A-Za-z0-9_]++\s?+)++"
MENTION = r"(?U)(?<!\b)@([A-Za-z0-9_]+)\b(?<!user)"
REPEATED_PLACEHOLDER = r"(@USER ){2,}"
PERCENTAGE = r"(?U)\b(\d+[.,]?\d*|\d{2}[AP]M)%"
NUMBER = r"(?U)\b(\d+[.,]?\d*|\d{2}[AP]M)\b"
BLANKS = r"(?U)\s+"
ORPHAN_DOTS = r"(?U)[.\s]{2,}"
DASH = r" [-—] "
ORPHAN_MARKS = r"(?U)\s+([?!])+"
QUOTES = "\"“”'«»‘’"
PUNCTUATION = r"[.|+()]+"
GENDER = r"(?iuU)\b(\p{L}+)@s\b"
LAUGH = r"(?iuU)(?=[mj])\b(mua)?j[ja]+a?\b"
LAUGH_WORD = "jajaja"
ELONGATION = r"(?d)(.)\1{2,}"
MARK_RUN = r"([!¡?¿])\1+"
VOWELS = ("aá", "eé", "ií", "oó", "uú")
CAMEL_PART = r"(?d).+?(?:(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|[0-9]+|$)"
STRIP_CHARACTERS = " \r\n\t,.?"
ELLIPSIS = "…"
USER_PLACEHOLDER = "[USUARIO]"
NUMBER_PLACEHOLDER = "[NUMERO]"
PERCENTAGE_PLACEHOLDER = "[PORCENTAJE]"
HASHTAG_TEMPLATE = "#[HASHTAG]_$1"
SYNDICATED = r"(?d)((a través de|v[íi]a)) @+[\[A-Za-zÑñ\d_]+$|\||#endirecto"
HANDLE = r"@([A-Za-z0-9_]+)"
MERGE_SEPARATOR = " [SEP] "
MULTI_LABEL_SEPARATOR = "; "
WORD_RUN = r"(?U)\w+"
BETWEEN_WORDS = r"(?U)\W+"

# --- Fixed values: vocabulary tokenizer -------------------------------------
TOKEN_FILTER = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n¡¿"
WORD = r"[\p{L}\p{M}\p{N}_]{2,}"

# --- Fixed values: age bins, open on the left, closed on the right ----------
AGE_EDGES = (0, 13, 18, 25, 35, 50, 65, 999)
AGE_LABELS = ("0-12", "13-17", "18-24", "25-34", "35-49", "50-64", "over-65")

# --- Fixed values: corpus limits ---------------------------------------------
MIN_DOCUMENTS = 120
MAX_DOCUMENTS = 200
TRAIN_AUTHORS = 166
SAMPLED_PER_AUTHOR = 80
LANGUAGE_THRESHOLD = 0.75
IMBALANCE_THRESHOLD = 0.15
MAD_SCALE = 2 / 3**0.5

# --- Fixed values: chat terms, applied in this order -------------------------
CHAT_TERMS = {
    r"ad\+": "además",
    "bno": "bueno",
    "d": "de",
    "dl": "del",
    "dra": "doctora",
    "dr": "doctor",
    "dsps": "después",
    "gob": "gobierno",
    "m da": "me da",
    "mñn": "mañana",
    "knto": "cuánto",
    "h1n1": "gripe",
    "k": "que",
    "kx": "porque",
    "q": "que",
    "qndo": "cuando",
    "toy": "estoy",
    "tb": "también",
    "pa": "para",
    "ppio": "principio",
    "tdv": "todavía",
    "tmb": "también",
    "tkm": "te quiero mucho",
    "tp": "tampoco",
    "salu2": "saludos",
    "x": "por",
    "xq": "porque",
    r"xq\?": "por qué",
    "100pre": "siempre",
    "1ra": "primera",
    "2da": "segunda",
    "3ra": "tercera",
    "€+": "euros",
}
MONTHS = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
# A day followed by a month cut to three letters becomes "day de month".
SHORT_DATE = rf"(?iuU)\b[0-3][0-9](?:\s?de\s?)?(?:{'|'.join(month[:3] for month in MONTHS)})\b"

# --- Fixed values: acronyms, applied in this order ---------------------------
ACRONYMS = {
    "TVE": "Televisión Española",
    "OMS": "Organización Mundial de la Salud",
    "EEUU": "Estados Unidos",
    "SM": "Su Majestad",
    "GAL": "Grupos Antiterroristas de Liberación",
    "UE": "Unión Europea",
    "PAC": "Política Agraria Común",
    "CCAA": "Comunidades Autónomas",
    "ERTE": "Expediente de Regulación de Empleo",
    "ERTES": "Expedientes de Regulación de Empleo",
    "MEFP": "Ministerio de Educación y Formación Profesional",
    "BCE": "Banco Central Europeo",
    "FMI": "Fondo Monetario Internacional",
    "OCDE": "Organización para la Cooperación y el Desarrollo Económicos",
    "MIR": "Médico Interno Residente",
    "ETA": "Euskadi Ta Askatasuna",
    "CSIC": "Consejo Superior de Investigaciones Científicas",
    "LGTB": "Lesbianas, Gais,​ Bisexuales y Transgénero",
    r"LGTB[\w\+]?": "Lesbianas, Gais,​ Bisexuales y Transgénero",
    "IVA": "Impuesto al valor agregado",
    "CE": "Constitución Española",
    "CM": "Congreso de Ministros",
    "CLM": "Castilla La Mancha",
    "CyL": "Castilla y León",
    "CAM": "Comunidad de Madrid",
    "BCN": "Barcelona",
    "MWC": "Mobile World Congress",
    "G. Mixto": "Grupo Mixto",
    "PGE": "Presupuestos Generales del Estado",
    "PNV": "Partido Nacionalista Vasco",
    "PP": "Partido Popular",
    "PSOE": "Partido Socialista Obrero Español",
    "UP": "Unidas Podemos",
}

# --- Fixed values: pictographs (Unicode emoji list, as code-point ranges) ----
EMOJI_BASE = (
    r"\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}"
    r"\x{231A}\x{231B}\x{2328}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}"
    r"\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2604}\x{260E}\x{2611}"
    r"\x{2614}\x{2615}\x{2618}\x{261D}\x{2620}\x{2622}\x{2623}\x{2626}\x{262A}\x{262E}"
    r"\x{262F}\x{2638}-\x{263A}\x{2640}\x{2642}\x{2648}-\x{2653}\x{265F}\x{2660}\x{2663}"
    r"\x{2665}\x{2666}\x{2668}\x{267B}\x{267E}\x{267F}\x{2692}-\x{2697}\x{2699}\x{269B}"
    r"\x{269C}\x{26A0}\x{26A1}\x{26A7}\x{26AA}\x{26AB}\x{26B0}\x{26B1}\x{26BD}\x{26BE}"
    r"\x{26C4}\x{26C5}\x{26C8}\x{26CE}\x{26CF}\x{26D1}\x{26D3}\x{26D4}\x{26E9}\x{26EA}"
    r"\x{26F0}-\x{26F5}\x{26F7}-\x{26FA}\x{26FD}\x{2702}\x{2705}\x{2708}-\x{270D}\x{270F}"
    r"\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}"
    r"\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}\x{2764}\x{2795}-\x{2797}\x{27A1}"
    r"\x{27B0}\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}"
    r"\x{3030}\x{303D}\x{3297}\x{3299}\x{1F004}\x{1F0CF}\x{1F170}\x{1F171}\x{1F17E}"
    r"\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1E6}-\x{1F1FF}\x{1F201}\x{1F202}\x{1F21A}"
    r"\x{1F22F}\x{1F232}-\x{1F23A}\x{1F250}\x{1F251}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}"
    r"\x{1F7E0}-\x{1F7EB}\x{1F90C}-\x{1F9FF}\x{1FA70}-\x{1FAFF}"
)
# A pictograph with what may follow it (selector, skin tone, tag letters), joined
# into families by U+200D; or a keycap.
# The look-ahead names the few blocks they live in, so ordinary letters are passed over cheaply.
_EMOJI_NEAR = r"(?=[\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F004}-\x{1FAFF}])"
_EMOJI_ONE = rf"{_EMOJI_NEAR}[{EMOJI_BASE}][\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}\x{{E0020}}-\x{{E007F}}]*+"
EMOJI = rf"{_EMOJI_ONE}(?:\x{{200D}}{_EMOJI_ONE})*+|[0-9#*]\x{{FE0F}}?\x{{20E3}}"
