from patchlight.plans import extraction, ingest, kernels, labelling, queries, summaries  # noqa: F401  (all register their queries)
