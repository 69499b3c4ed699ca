"""Texts, labels and sizes that results depend on."""

# ---------------------------------------------------------------------------
# They must stay exactly as they are for results to agree.
# ---------------------------------------------------------------------------

VECTOR_DIM = 1536
DEFAULT_K = 10
WIDE_K = 100
DEFAULT_THRESHOLD = 0.8
DEFAULT_TEMPERATURE = 0.7
# Descriptions and answers from pages; only a chat with its history has the default.
FIXED_TEMPERATURE = 0.0
LINES_PER_PAGE = 10
TENANT_PAGE_SIZE = 10

PII_GROUPS = [
    "EMAIL_ADDRESS",
    "CREDIT_CARD",
    "PHONE_NUMBER",
    "SSN",
    "PERSON",
    "LOCATION",
    "DATE_TIME",
    "IP_ADDRESS",
    "USER",
    "SOCIALNUM",
    "B-SOCIALNUM",
    "I-SOCIALNUM",
]

WARNED_BEFORE = "\n\nWARNING: "
WARNED_AFTER = ". Do not include or refer to this specific PII in your metadata."

SAFE_MESSAGE = "No PII detected"
UNSAFE_MESSAGE = (
    "Potential PII detected in your message. "
    "Please remove personal information such as: "
)
PLACEHOLDER_CONTENT = "placeholder content for document with no text"
ENRICH_FAILED = "Error: LLM processing timed out or failed"
QUERY_FAILED = "An error occurred while processing your query. Please try again."
SUMMARY_QUESTION = (
    "Describe each of these webpages from the website. "
    "What is happening on each page?"
)
UNKNOWN = "Unknown"

ENRICH_PROMPT = (
    "Add to the metadata of a PDF file based on this page content of the file. "
    "The metadata you generate will "
    "be indexed into an opensearch instance. "
    "Put all descriptive data into the values "
    "section of the metadata. The existing metadata is {metadata}. "
    "The content of the page is: \n\n{text}\n\n"
    "Only return a JSON object with the additional keys and values."
)

ANSWER_PROMPT = """
    You are a helpful assistant that answers questions based on the provided documents.
    
    CONTEXT:
    {context}
    
    QUESTION:
    {question}
    
    Please provide a comprehensive answer based only on the information in the provided documents.
    If the answer cannot be determined from the context, politely say so.
    """

BEDROCK_MODELS = [
    "us.anthropic.claude-3-haiku-20240307-v1:0",
    "us.anthropic.claude-3-opus-20240229-v1:0",
    "us.anthropic.claude-3-sonnet-20240229-v1:0",
    "us.anthropic.claude-3-5-haiku-20241022-v1:0",
    "us.anthropic.claude-3-5-sonnet-20240620-v1:0",
    "us.anthropic.claude-3-5-sonnet-20241022-v2:0",
    "us.anthropic.claude-3-7-sonnet-20250219-v1:0",
    "us.anthropic.claude-opus-4-20250514-v1:0",
    "us.anthropic.claude-sonnet-4-20250514-v1:0",
    "us.deepseek.r1-v1:0",
    "us.meta.llama4-maverick-17b-instruct-v1:0",
    "us.meta.llama4-scout-17b-instruct-v1:0",
    "us.meta.llama3-1-70b-instruct-v1:0",
    "us.meta.llama3-1-8b-instruct-v1:0",
    "us.meta.llama3-2-11b-instruct-v1:0",
    "us.meta.llama3-2-1b-instruct-v1:0",
    "us.meta.llama3-2-3b-instruct-v1:0",
    "us.meta.llama3-2-90b-instruct-v1:0",
    "us.meta.llama3-3-70b-instruct-v1:0",
    "us.mistral.pixtral-large-2502-v1:0",
    "us.amazon.nova-lite-v1:0",
    "us.amazon.nova-micro-v1:0",
    "us.amazon.nova-premier-v1:0",
    "us.amazon.nova-pro-v1:0",
    "us.writer.palmyra-x4-v1:0",
    "us.writer.palmyra-x5-v1:0",
]

OPENAI_MODELS = [
    "gpt-3.5-turbo",
    "gpt-3.5-turbo-16k",
    "gpt-4",
    "gpt-4-turbo-preview",
    "gpt-4o",
    "chatgpt-4o",
    "gpt-4o-mini",
    "gpt-4-turbo",
    "gpt-4.1",
    "gpt-o3",
    "gpt-o3-pro",
    "gpt-o3-mini",
    "gpt-o1-mini",
    "gpt-o1-pro",
]

DEFAULT_MODEL_POSITION = 12

# ---------------------------------------------------------------------------
# Own texts, used where no model is plugged in.
# ---------------------------------------------------------------------------

NO_ANSWER = "The answer cannot be determined from the provided documents."
