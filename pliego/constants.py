"""Settings and texts that results depend on."""

# Sizes and limits.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SUMMARY_CHARS = 500
SUMMARY_MIN_TEXT = 300
SUMMARY_INPUT_CHARS = 5000
FILE_NAME_CHARS = 50
DEFAULT_K = 10
AGENT_K = 25
MIN_FETCH = 50
FETCH_FACTOR = 3
MMR_LAMBDA = 0.6
MISSING_PAGE_SORT = 999
HISTORY_MESSAGES = 4
OCR_MIN_CHARS = 500
SESSION_HOURS = 24

# Texts that appear in results.
DEFAULT_SOURCE = "desconocido"
UNKNOWN_SOURCE = "Desconocido"
UNNAMED_DOCUMENT = "Documento sin nombre"
UNKNOWN_DOCUMENT = "Documento desconocido"
NO_RESULTS = "[SIN RESULTADOS]"
NO_RESULTS_ANSWER = "La información solicitada no se encuentra en los documentos proporcionados."
NOT_IN_DOCUMENT = "No se especifica en el documento"
MODEL_ERROR = "Lo siento, hubo un error al procesar la respuesta."
SERVER_ERROR = "Lo siento, ocurrió un error en el servidor. Intente de nuevo."
SOURCES_MARKER = "FUENTES CONSULTADAS:"
GENERAL_KNOWLEDGE = "(Conocimiento general)"
SUMMARY_HEADING = "[RESUMEN DEL DOCUMENTO]"
FIRST_CHUNK_HEADING = "[FRAGMENTO 1]"
DEFAULT_USER = "user_default"
COVER_LABELS = ["Tutor:", "Tutores:", "Director:", "Trabajo de Diploma", "Autor:"]
COVER_IGNORE = ["Agradezco a", "Dedicado a"]

# Prompt formats. Braces name the columns that are filled in.
REWRITE_PROMPT = """
    Eres una herramienta de reformulación de búsqueda.
    Tu trabajo es reescribir la "PREGUNTA ACTUAL" para que sea totalmente independiente, basándote en el HISTORIAL.
    
    HISTORIAL:
    {history}
    
    PREGUNTA ACTUAL:
    {input}
    
    PREGUNTA REESCRITA (Solo el texto):
    """
ANSWER_PROMPT = """
    Eres un AUDITOR DE DOCUMENTOS ACADÉMICOS. Tu única fuente de verdad es el CONTEXTO proporcionado.
    
    INSTRUCCIONES CRÍTICAS SOBRE "TUTORES" Y "AUTORES":
    1. **LA PORTADA MANDA:** Busca nombres de Tutores, Autores o Títulos SIEMPRE en los fragmentos de las primeras páginas (Pág 1, 2).
    2. **IGNORA AGRADECIMIENTOS:** Es muy común que en la sección "Agradecimientos" o "Dedicatoria" se mencione a profesores. **ESO NO SON LOS TUTORES OFICIALES**. Ignora cualquier nombre que aparezca bajo "Agradezco a...", "Dedicado a...".
    3. **BUSCA ETIQUETAS:** Busca explícitamente las palabras "Tutor:", "Tutores:", "Director:", "Trabajo de Diploma", "Autor:".
    
    REGLAS GENERALES:
    - Si no encuentras el dato exacto, di "No se especifica en el documento".
    - No uses conocimiento externo.
    - Cita el fragmento donde encontraste el dato (Ej: [1]).
    
    CONTEXTO (ORDENADO POR PÁGINA):
    {context}
    
    PREGUNTA:
    {input}
    
    RESPUESTA:
    """

# The white space that the two kinds of strip remove (Python text, browser text).
PYTHON_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
BROWSER_BLANKS = (
    "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f"
    "\u3000\ufeff"
)
TOKEN_BREAK = r"[^\p{L}]+"

# Our own settings.
VECTOR_BUCKETS = 64
