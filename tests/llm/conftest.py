import os
import sys
import types

# The helpers of this folder under one name, whatever folder pytest starts in.
_here = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(_here)))
package = types.ModuleType("tests_llm")
package.__path__ = [_here]
sys.modules.setdefault("tests_llm", package)
