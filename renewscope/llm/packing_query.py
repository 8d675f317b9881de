"""Query of the packing; a tokenizer is not SQL, so tests put every document together again."""

from renewscope.llm.common import table
from renewscope.llm.packing import pack_documents
from renewscope.llm.tokens import default_tokenizer


def op8_packing(spark, sf_dir):
    """Pieces of every document and where they lie."""
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
