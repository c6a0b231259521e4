"""Nothing here on purpose: all inputs are bounded files, so no streaming operator is offered."""
