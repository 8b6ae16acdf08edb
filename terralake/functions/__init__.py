from .codec import *  # noqa: F401,F403
from .geo import *  # noqa: F401,F403
from .names import *  # noqa: F401,F403
