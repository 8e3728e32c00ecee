"""Order-dependent state machines, in batch and as stateful streams."""
