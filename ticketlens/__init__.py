"""ticketlens: issue-triage data engine on Spark.

Main entry points:

* ``plans.dataset.build_dataset``   -- cleaned, leakage-free, chronologically split training rows
* ``plans.triage.triage_issues``    -- payloads to triage status, scores, chosen labels and a write plan
* ``streaming.triage``              -- the same triage as a stream, and a replay-safe label sink
* ``operators.evaluate``            -- multi-label metrics and the per-taxonomy threshold sweep
* ``functions.text.clean_columns``  -- the text contract as Column expressions
* ``sources.catalog.load_artifacts``-- a validated label catalog from a model bundle
"""
