"""Query of the token files; a tokenizer is not SQL, so tests compare with plain encoding."""

from renewscope.llm.common import table
from renewscope.llm.token_files import read_shards, write_shards
from renewscope.llm.tokens import default_tokenizer
from renewscope.session import shared_dir


def op7_token_files(spark, sf_dir):
    """Place, length and checksum of every document's ids, read back from the files."""
    folder = shared_dir(spark, "token-files")
    listed = write_shards(table(spark, sf_dir, "documents"), folder, default_tokenizer())
    return read_shards(spark, folder, listed).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op7_token_files": op7_token_files}
ORACLES: dict[str, str] = {}
