"""The residue models fitted on the pages of a folder's documents, without Spark."""

import numpy as np
import pandas as pd

from strandloom.llm import residue


def natural_tables(folder):
    texts = pd.read_parquet(f"{folder}/documents.parquet", columns=["text"]).text
    counts = np.zeros(residue.CLASSES**residue.GRAM, dtype=np.int64)
    for _, joined in residue._chunks([t for t in texts if t]):
        code, crosses = residue._grams(joined)
        counts += np.bincount(code[~crosses], minlength=len(counts))
    return residue.fit(counts)
