"""sparqa: question-answer data curation, formatting and scoring as Spark plans.

Every operator is either ``Column -> Column`` (``sparqa.functions``) or
``DataFrame -> DataFrame`` (``sparqa.operators``); composed pipelines live in
``sparqa.plans``. Nothing here collects data to the driver.
"""

__version__ = "0.1.0"
