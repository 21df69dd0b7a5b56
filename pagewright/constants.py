"""Fixed values.

Everything in this module must equal the behaviour being matched: prices,
conversion rates, thresholds, phrase lists, patterns, fixed texts.  They are
stated plainly here, in natural order, and every operator reads them from here
(or takes an override parameter).
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: money
# ---------------------------------------------------------------------------
USD_TO_INR = 83.0
CHARS_PER_TOKEN = 4.0

# chat model (per-token USD, as the code computes it, not as its comment says)
CHAT_INPUT_USD_PER_TOKEN = 0.000015 / 1000
CHAT_OUTPUT_USD_PER_TOKEN = 0.0006 / 1000
# custom hosted model: USD per 1k tokens, input and output alike
CUSTOM_USD_PER_1K_TOKENS = 0.002
# hosted general model: USD per 1k tokens
GEMINI_INPUT_USD_PER_1K = 0.00025
GEMINI_OUTPUT_USD_PER_1K = 0.00075
# training: USD per hour
TRAINING_USD_PER_HOUR = 1.5
# page processing (INR): per 1000 read transactions, and per page for forms
PAGE_READ_INR_PER_1000 = 0.83
PAGE_FORM_INR_PER_PAGE = 0.004

# cost report
INFRASTRUCTURE_COST_INR = 2.50
BUDGET_INR = 500.0
COST_BAND_EXCELLENT_BELOW = 1.0
COST_BAND_GOOD_BELOW = 2.0

# budget alert thresholds (share of the monthly amount)
BUDGET_ACTUAL_THRESHOLDS = (0.80,)
BUDGET_FORECAST_THRESHOLDS = (0.95,)
BUDGET_GCP_THRESHOLDS = (0.80, 0.90, 1.00)

# ---------------------------------------------------------------------------
# FIXED VALUES: documents
# ---------------------------------------------------------------------------
MAX_DOCUMENT_MB = 50
SUPPORTED_FORMATS = ("pdf", "png", "jpg", "jpeg", "tiff", "bmp")
FILES_PER_DIRECTORY = 3  # used only where a caller asks for it
NO_TEXT_FALLBACK = "No text could be extracted from this page."
CONFIDENCE_CLOSE_WITHIN = 0.1
DEFAULT_LINE_CONFIDENCE = 0.8
PAGE_IMAGE_NAME = "page_%03d.png"
PAGE_BREAK = "\f"
PREVIEW_CHARS = 200
ENTITY_LIMIT = 50  # used only where a caller asks for it
SUMMARY_SENTENCES = 3

# reading sources and their preference when confidences are close
SOURCE_CV = "azure_cv"
SOURCE_TESSERACT = "tesseract"
SOURCE_FORM = "azure_form_recognizer"
SOURCE_PREFERENCE = {SOURCE_FORM: 3, SOURCE_CV: 2, SOURCE_TESSERACT: 1}
# list order of the readings (ties on confidence go to the earlier one)
SOURCE_ORDER = (SOURCE_CV, SOURCE_TESSERACT, SOURCE_FORM)

# entity patterns, in emission order: (type, confidence, pattern)
ENTITY_PATTERNS = (
    ("date", 0.9, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b"),
    ("monetary_amount", 0.8, r"\$[\d,]+\.?\d*|\b\d+\.?\d*\s*(?:dollars?|USD|INR|₹)\b"),
    ("percentage", 0.9, r"\b\d+\.?\d*\s*%\b"),
    ("email", 0.95, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone_number", 0.8, r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b|\b\+?\d{1,3}[-.]?\d{3,4}[-.]?\d{6,10}\b"),
)
CASE_INSENSITIVE_ENTITIES = ("monetary_amount",)

# ---------------------------------------------------------------------------
# FIXED VALUES: question answering
# ---------------------------------------------------------------------------
SAFETY_BLOCK_BELOW = 0.5
SAFETY_SEVERITY_SCALE = 6.0
SAFETY_REFUSAL = "I cannot process this query due to safety concerns."
GENERATION_APOLOGY = "I apologize, but I encountered an error while processing your request."
QUERY_ERROR_PREFIX = "Error processing query: "
PAGE_ERROR_TEMPLATE = "Error processing page %d: %s"

# blanks between words: Unicode white space and the four separators U+001C-U+001F
BLANKS = r"(?U)[\s\x1c-\x1f]+"

# grounded confidence (chat): thresholds and factor values
GROUNDED_CONTEXT_STEPS = ((100, 0.8), (50, 0.6))
GROUNDED_CONTEXT_ELSE = 0.3
GROUNDED_RESPONSE_STEPS = ((200, 0.9), (100, 0.7))
GROUNDED_RESPONSE_ELSE = 0.5
GROUNDED_UNCERTAIN_PHRASES = ("I don't know", "unclear", "not specified", "not mentioned")
# bare confidence (custom model)
BARE_RESPONSE_OVER = 50
BARE_RESPONSE_YES, BARE_RESPONSE_NO = 0.8, 0.5
BARE_QUERY_WORDS_OVER = 5
BARE_QUERY_YES, BARE_QUERY_NO = 0.7, 0.9
BARE_UNCERTAIN_PHRASES = ("I don't know", "unclear", "not sure", "maybe")
UNCERTAIN_YES, UNCERTAIN_NO = 0.4, 0.8
CONFIDENCE_WHEN_OFF = 0.8
GEMINI_CONFIDENCE = 0.85

BATCH_SIZE = 10
BATCH_PAUSE_SECONDS = 1.0
RETRIEVAL_TOP_K = 5
SEARCH_TOP_K = 10
SEARCH_THRESHOLD = 0.8

# grounded prompt (system part and user part)
SYSTEM_PROMPT = """
            You are an expert document analyst with deep knowledge across business domains.
            Your task is to answer questions based solely on the provided document context.
            
            Guidelines:
            1. Use only information from the provided context
            2. Be precise, comprehensive, and well-structured in your responses
            3. If the context doesn't contain relevant information, clearly state this
            4. Provide specific details and numbers when available
            5. Maintain a professional and helpful tone
            6. Structure responses with numbered points when appropriate
            """
USER_PROMPT_TEMPLATE = """
            Context from documents:
            %s
            
            User question: %s
            
            Please provide a detailed, accurate answer based on the document context above.
            """
# three-turn transcript used when a system prompt is given
TRANSCRIPT_ACK = "I understand. I'll follow these instructions."

# ---------------------------------------------------------------------------
# FIXED VALUES: reporting
# ---------------------------------------------------------------------------
RECOMMEND_COST_OVER = 100.0
RECOMMEND_CONFIDENCE_BELOW = 0.8
RECOMMEND_PROCESSING_OVER = 30.0
# (category, priority, recommendation, note)
RULE_RECOMMENDATIONS = (
    ("cost_optimization", "medium", "Consider implementing request caching to reduce API calls",
     "15-25% cost reduction"),
    ("model_performance", "high", "Fine-tune models with domain-specific data to improve confidence scores",
     "10-20% confidence increase"),
    ("performance_optimization", "medium", "Implement parallel processing for multimodal documents",
     "30-50% faster processing"),
)
FIXED_RECOMMENDATIONS = (
    ("scalability", "high", "Implement auto-scaling for production workloads",
     "Handle traffic spikes efficiently"),
    ("monitoring", "medium", "Set up real-time alerting for cost thresholds",
     "Prevent budget overruns"),
    ("security", "high", "Implement private endpoints for production deployment",
     "Enhanced security posture"),
)

# health
HEALTHY = "healthy"
DEGRADED = "degraded"
UNHEALTHY = "unhealthy"
VERTEX_DECISIVE_SERVICE = "vertex_ai_models"

# alerting
ERROR_RATE_WINDOW_SECONDS = 300
ERROR_RATE_THRESHOLD_PER_SECOND = 5.0
ERROR_SEVERITIES = ("ERROR", "CRITICAL", "ALERT", "EMERGENCY")
RETENTION_DAYS = 30
STREAM_WATERMARK = "10 minutes"

# training data
TRAIN_FRACTION_PERCENT = 80

# turns of one transcript row (bounds what one task gathers)
TRANSCRIPT_CHUNK_TURNS = 200

# rows that a report shows of each kind
REPORT_SAMPLES = {"queries": 2, "documents": 1, "recommendations": 3}
