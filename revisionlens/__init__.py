"""revisionlens: document-revision analytics as Spark DataFrame operators.

Versions of a text go in; sentences, tokens, word vectors, sentence matches,
edit labels (kept / edited / added / deleted / moved) and roll-up statistics
come out.  Every operator is a ``DataFrame -> DataFrame`` function usable with
``df.transform``; nothing is collected to the driver.
"""

from revisionlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
