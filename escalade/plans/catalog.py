"""Imports every plan module so the registry is complete."""

from escalade.plans import decision_plans  # noqa: F401
from escalade.plans import text_plans  # noqa: F401
from escalade.plans import subword_plans  # noqa: F401
from escalade.plans import model_plans  # noqa: F401
from escalade.plans import key_plans  # noqa: F401
from escalade.plans import proba_plans  # noqa: F401
from escalade.plans import profile_plans  # noqa: F401
from escalade.plans import io_plans  # noqa: F401
from escalade.plans.registry import ORACLES, PLANS  # noqa: F401
