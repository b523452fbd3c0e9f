"""Options and fixed values.

Everything under "FIXED VALUES" must stay equal to the behaviour being matched
(limits, templates, messages, styles, the language list).  Everything else is an
option with a default.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the matched behaviour; do not edit)
# ---------------------------------------------------------------------------
CHUNK_SIZE = 4000                    # characters per model call
CHARS_PER_PAGE = 3000                # DOCX page size in characters
MAX_PAGES_PER_CHAPTER = 10           # DOCX page cap; surplus is dropped
MAX_RETRIES = 3                      # attempts = MAX_RETRIES + 1
BACKOFF_BASE = 2                     # wait after failure r (1-based) = 2 ** r seconds
MAX_CHAPTERS = 100                   # inclusive
MAX_FILE_SIZE = 10485760             # bytes, inclusive
USE_BACKGROUND_TASKS = True
MODEL = "gpt-4-turbo-preview"
TEMPERATURE = 0.3
MAX_TOKENS = 4000
PDF_CONTENT_TYPE = "application/pdf"
PARAGRAPH_SEPARATOR = "\n\n"         # PDF layout splits chapters here
CHUNK_JOINER = "\n"                  # translated chunks are joined with this

# Python's str.isspace() set, in code-point order: what strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# UI language list, in UI order.
LANGUAGES = [
    "Português",
    "Espanhol",
    "Francês",
    "Alemão",
    "Italiano",
    "Japonês",
    "Chinês",
    "Coreano",
]
DEFAULT_TARGET_LANGUAGE = "Português"

# Text templates.
TITLE_PREFIX = "Capítulo "
DOWNLOAD_BASENAME = "livro_traduzido"
OUTPUT_DIR = "output"
STATUS_URL_PREFIX = "/api/translation/status/"

# Job statuses and their messages.
STATUS_QUEUED = "queued"
STATUS_PENDING = "pending"
STATUS_TRANSLATING = "translating"
STATUS_FORMATTING = "formatting"
STATUS_COMPLETED = "completed"
STATUS_ERROR = "error"
MSG_QUEUED = "Trabalho em fila para processamento..."
MSG_PENDING = "PDF queued for translation"
MSG_TRANSLATING = "Iniciando tradução dos capítulos..."
MSG_CHAPTER_PREFIX = "Traduzindo capítulo "          # + "{id}/{total}..."
MSG_FORMATTING = "Formatando documento..."
MSG_COMPLETED = "Tradução e formatação concluídas!"
MSG_ERROR_PREFIX = "Erro: "
MSG_SUBMITTED = "Tradução iniciada. Use o endpoint de status para verificar o progresso."
MSG_MISSING_AS_DONE = "Tradução concluída. O arquivo está pronto para download."
PROGRESS = {
    STATUS_QUEUED: 0.0,
    STATUS_PENDING: 0.0,
    STATUS_TRANSLATING: 0.1,
    STATUS_FORMATTING: 0.7,
    STATUS_COMPLETED: 1.0,
}
PROGRESS_TRANSLATE_START = 0.1
PROGRESS_TRANSLATE_SPAN = 0.6

# Reject reasons (server side, then client side).
REJECT_NO_CHAPTERS = "No chapters provided"
REJECT_TOO_MANY_CHAPTERS = "Maximum {max} chapters allowed"
REJECT_NOT_PDF = "Only PDF files are supported"
REJECT_TOO_LARGE = "File size exceeds the maximum limit of {mb}MB"
REJECT_NO_TEXT = ("Failed to extract text from the PDF. The file might be encrypted, "
                  "damaged, or contain only images.")
REJECT_TOO_MANY_PAGES = ("The PDF contains too many pages/chapters ({n}). "
                         "Maximum allowed is {max}.")
REJECT_EXTRACT_ERROR = "Error processing PDF: {e}"
REJECT_BLANK_CHAPTER = "Por favor, preencha todos os capítulos"
RETRY_ERROR = "Translation error after {n} attempts: {e}"

# Download gate outcomes: (http status, detail), checked in this order.
GATE_UNKNOWN = (404, "Translation job not found")
GATE_NOT_DONE = (400, "Translation job not completed yet")
GATE_NO_PATH = (404, "Output file not found")
GATE_FILE_GONE = (404, "Output file not found on server")

# Mock models (test doubles): prefix + language + bounded preview + "...".
MOCK_TEXT_PREFIX = "Translated to "
MOCK_TEXT_PREVIEW = 20
MOCK_CHAPTER_PREFIX = "Chapter translated to "
MOCK_CHAPTER_PREVIEW = 30

# Page and style constants: (format, kind) -> style.
PAGE_WIDTH_IN = 6.0
PAGE_HEIGHT_IN = 9.0
MARGIN_LEFT_IN = 0.75
MARGIN_RIGHT_IN = 0.5
MARGIN_TOP_IN = 0.5
MARGIN_BOTTOM_IN = 0.5
STYLES = [
    # format, kind,     font,          size, align,     leading, indent, space_after, height_in
    ("docx", "title",   "Georgia",     30.0, "RIGHT",   None,    None,   None,        None),
    ("docx", "body",    "Georgia",     11.0, None,      None,    None,   None,        None),
    ("docx", "dropcap", "Georgia",     30.0, None,      None,    None,   None,        None),
    ("docx", "number",  None,          None, "PARITY",  None,    None,   None,        None),
    ("docx", "break",   None,          None, None,      None,    None,   None,        None),
    ("pdf",  "break",   None,          None, None,      None,    None,   None,        None),
    ("pdf",  "title",   "Times-Bold",  30.0, "RIGHT",   None,    None,   24.0,        None),
    ("pdf",  "spacer",  None,          None, None,      None,    None,   None,        0.2),
    ("pdf",  "body",    "Times-Roman", 11.0, "JUSTIFY", 14.0,    20.0,   None,        None),
    ("pdf",  "gap",     None,          None, None,      None,    None,   None,        0.1),
]
TITLE_SPACER_IN = 0.2
PARAGRAPH_SPACER_IN = 0.1
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """Upload / book limits; every field may be overridden per run or tenant."""
    max_file_size: int = MAX_FILE_SIZE
    max_chapters: int = MAX_CHAPTERS
    use_background_tasks: bool = USE_BACKGROUND_TASKS


@dataclass(frozen=True)
class ModelOptions:
    """Options handed to the model factory and carried in the run log."""
    model: str = MODEL
    temperature: float = TEMPERATURE
    max_tokens: int = MAX_TOKENS
    source_language: str = "English"
    # {source} and {target} are substituted, target twice.
    system_template: str = "Source: {source}. Target: {target}. Reply in {target}."


@dataclass(frozen=True)
class PipelineOptions:
    chunk_size: int = CHUNK_SIZE
    chars_per_page: int = CHARS_PER_PAGE
    max_pages: int | None = None     # None: no page of a chapter is dropped
    max_retries: int = MAX_RETRIES
    target_language: str = DEFAULT_TARGET_LANGUAGE
    output_format: str = "docx"
    dedupe: bool = False        # one model call per distinct (language, chunk text)
    limits: Limits = field(default_factory=Limits)
    model: ModelOptions = field(default_factory=ModelOptions)

    def with_(self, **kw) -> "PipelineOptions":
        return replace(self, **kw)
