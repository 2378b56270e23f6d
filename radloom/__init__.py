"""radloom: imaging-metadata ETL, cohort selection and de-identification on Spark."""

from radloom.session import build_session, pin, tune

__all__ = ["build_session", "pin", "tune"]
