"""Limits, enumerations and lookup tables that results depend on.

Everything here is a constant of the domain (thresholds, word lists, page
templates).  They are kept as plain literals so that they can be checked by eye.
"""

# --- intake limits -----------------------------------------------------------
MAX_DOCUMENT_BYTES = 5 * 1024 * 1024
MAX_DOCUMENT_PAGES = 10
RENDER_WIDTH = 720
MAX_RENDER_HEIGHT = 4000
MAX_RENDER_AREA = 8_000_000
MAX_IMAGE_SIDE = 2000
IMAGE_MIME_PATTERN = r"(?i)^image/(?:jpeg|png|webp|bmp|gif)$"
PDF_MIME = "application/pdf"
DIRECT_MIMES = ("image/jpeg", "image/png", "image/webp")

# --- pixel rules -------------------------------------------------------------
WHITE_ABOVE = 245
BLACK_BELOW = 20
ALPHA_OPAQUE = 128
BLANK_RATIO = 0.995
PIXEL_STEP = 4
COLOUR_TOLERANCE = 15
MIN_CROP_SHARE = 0.15
MIN_CROP_SIDE = 8

# --- text detection maps and corner heat maps --------------------------------
TEXT_CELL_ABOVE = 0.2
BOX_SCORE_MIN = 0.45
MAX_BOXES = 3000
UNCLIP_RATIO = 1.4
MIN_BOX_AREA = 4
PARALLEL_BELOW = 1e-9
MIN_BOX_CELLS = 3
HEAT_CELL_MIN = 0.3
FRAME_PAD = 100

# --- recognition and rotation ------------------------------------------------
DETECTOR_MAX_SIDE = 960
DETECTOR_MULTIPLE = 32
MIN_OCR_SIDE = 8
LINE_HEIGHT = 48
LINE_BASE_WIDTH = 320
LINE_MAX_RATIO = 32
LINES_PER_CHUNK = 16
EMPTY_MAP_MASS = 0.0005
CONFIDENT = 0.9
TOP_BOXES = 2
ROTATION_ORDER = (0, 270, 90, 180)

# --- event-time rules --------------------------------------------------------
QUIET_MS = 1500
COOLDOWN_MS = 60_000
STRIKES = 2
MAX_NOTICES = 4

# --- money -------------------------------------------------------------------
CURRENCY_SYMBOLS = {"USD": "US$", "ARS": "AR$", "EUR": "€", "BOB": "Bs"}
DEFAULT_CURRENCY = "BOB"
AMOUNT_PATTERN = r"(?:\d{1,3}(?:,\d{3})+\.\d{2}|\d+\.\d{2})"
AMOUNT_PREFIX = r"(?:Bs\.?|BOB|\$)?\s*"
# Unicode white space as browsers define it (wider than Java's \s).
WIDE_SPACES = "\\s\\u000B\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
WIDE_SPACE = f"[{WIDE_SPACES}]"
NOT_SPACE = f"[^{WIDE_SPACES}]"

# --- settings ----------------------------------------------------------------
CODE_CORNERS = ("sup-izq", "sup-der", "inf-izq", "inf-der")
DEFAULT_CORNER = "inf-der"
RETIRED_KEYS = ("configIA", "codigoLongitud")
CODE_KEYS = ("codigoActivo", "codigoValor", "codigoPosicion")

# --- status and reject reasons -----------------------------------------------
PENDING, RUNNING, DONE, FAILED = "pendiente", "procesando", "ok", "error"
REASONS = {
    "tamano": ("Archivo demasiado pesado", "pesa más de 5 MB, comprimila y probá de nuevo"),
    "paginas": ("PDF demasiado largo", "tiene más de 10 páginas, partila en dos PDF"),
    "cifrado": (
        "PDF protegido con contraseña",
        "protegido con contraseña, quitásela y volvé a subir",
    ),
    "ilegible": (
        "No se pudo leer",
        "no se pudo leer: puede estar corrupta, probá con otra foto",
    ),
}
FORMAT_TITLE = "Formato no soportado"
FORMAT_TEXT = "formato no soportado: usá JPG, PNG, WEBP o PDF"
CODE_INVALID = "Código inválido: revisá los dígitos."
NOTHING_TO_EXPORT = "Sin comprobantes para exportar."
NO_SUCH_SLOT = "no such slot"
NOTHING_PENDING = "Sin pendientes (todo ya tiene total o es manual)."
NOTHING_READ = "Sin totales para leer: revisá manualmente o recortá de nuevo."

# --- page templates: rows, columns, then one (row, col, colspan, rowspan) per slot
LAYOUTS = {
    "u1": (1, 2, [(1, 1, 2, 1)]),
    "u2h": (1, 2, [(1, 1, 1, 1), (1, 2, 1, 1)]),
    "u2v": (2, 1, [(1, 1, 1, 1), (2, 1, 1, 1)]),
    "u3h": (2, 2, [(1, 1, 1, 1), (2, 1, 1, 1), (1, 2, 1, 2)]),
    "u3v": (3, 1, [(1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1)]),
    "u3m": (2, 2, [(1, 1, 1, 1), (1, 2, 1, 1), (2, 1, 2, 1)]),
    "u4x2": (2, 2, [(1, 1, 1, 1), (1, 2, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1)]),
    "u5m": (2, 6, [(1, 1, 2, 1), (1, 3, 2, 1), (1, 5, 2, 1), (2, 1, 3, 1), (2, 4, 3, 1)]),
    "u6x2": (
        2,
        3,
        [(1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1), (2, 3, 1, 1)],
    ),
    "u6m": (
        3,
        2,
        [(1, 1, 1, 1), (1, 2, 1, 1), (2, 1, 1, 1), (2, 2, 1, 1), (3, 1, 1, 1), (3, 2, 1, 1)],
    ),
}
DEFAULT_LAYOUT = "u4x2"

# --- sheet geometry (inches, and EMU per inch / per pixel) --------------------
PAGE_WIDTH, PAGE_HEIGHT = 8.5, 11.0
MARGIN, CODE_BAND, GUTTER = 0.3, 0.3, 0.15
BAND_SIDES = ("sup", "inf", "")  # the code band above, below, or none
EMU_PER_INCH, EMU_PER_PX = 914_400, 9525
