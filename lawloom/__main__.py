from lawloom.plans.pipeline import main

main()
