"""The queries of this subpackage and the SQL that states the same result."""

from nearfold.llm import bitpack, linededup, linkgraph, langid, mixing, mpegaudio, packing, sharding, simhash, vectors

MODULES = (simhash, linededup, bitpack, sharding, mixing, linkgraph, packing, mpegaudio, vectors, langid)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
